"""Commands over files: each reads its inputs strictly, calls one function of the library, and publishes a new folder.

Exit codes: 0 where a result was produced, 2 where input is invalid or a plan infeasible; the reason goes to failure.json beside the target.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo, engine, sinks, sources
from .operators import budget, candles, demand, evaluation, exposure, factors, ledgers, network, returns
from .operators.budget import Budget
from .operators.returns import InputError
from .sources import nav, observations

Command = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, Command] = {}


def command(name: str):
    def keep(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return keep


def _json(path: str) -> dict:
    """A JSON object from a file, or from the standard input for ``-``."""
    got = sources.strict_json(sys.stdin.buffer.read(sources.LARGEST + 1) if path == "-" else sources.local_input(path))
    if not isinstance(got, dict):
        raise InputError("an input is a JSON object")
    return got


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of JSON under a schema; fields that the schema doesn't have raise, dates are text."""
    names = [c.split()[0] for c in schema.split(", ")]
    for r in rows:
        if extra := set(r) - set(names):
            raise InputError(f"unknown fields {sorted(extra)}")
    kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    cast = {"date": lambda v: dt.date.fromisoformat(v), "double": float, "int": int, "timestamp": dt.datetime.fromisoformat}
    return spark.createDataFrame([tuple(None if r.get(n) is None else cast.get(kinds[n], lambda v: v)(r[n]) for n in names) for r in rows], schema)


#: Rows of a result that is written as one JSON document.
MOST = 10_000


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result that is small by its contract. A larger one raises: nothing is left out silently."""
    got = df.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise InputError(f"a result has more than {MOST} rows, too many for one document; use the library's tables")
    return [sinks.clean(r.asDict(recursive=True)) for r in got]


@command("run")
def run(spark: SparkSession, a: argparse.Namespace) -> int:
    panel = sources.read_wide(spark, a.returns, a.kind)
    assets = sorted(r["asset"] for r in panel.select("asset").distinct().collect())
    report = engine.run(panel, _json(a.config), sources.read_factors(spark, a.factors, panel) if a.factors else None, sources.read_orders(spark, a.orders, assets) if a.orders else None)
    sinks.save_report(report, a.output)
    return 0 if report.reference else 2


@command("demo")
def made(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.save_report(engine.run(demo.panel(spark, a.seed), demo.config(a.seed)), a.output, "Synthetic demonstration")
    return 0


@command("prepare")
def prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    """Net asset values and events become returns on the dates that all assets have; a date that one lacks raises."""
    spec = _json(a.input)
    values = nav.dated_rows(_table(spark, spec["nav"], "code string, date date, nav double"), "nav", "code")
    events = _table(spark, spec.get("events", []), "code string, date date, cash double, split double")
    index = returns.total_return_index(values, events)
    r = returns.pct_change(index.select("date", F.col("code").alias("asset"), F.col("index").alias("px")))
    sources.publish({"returns": returns.checked_returns(r)}, {"title": "prepare", "input_digest": sources.digest(spec)}, a.output, formats={"returns": "csv"})
    return 0


@command("m2-evaluate")
def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    panel, spec = sources.read_wide(spark, a.returns, a.kind), _json(a.config)
    fold, boot = dict(spec.get("m2_walk_forward", {})), dict(spec.get("bootstrap", {}))
    step = fold.get("test_steps", 126)
    plan = Budget(boot.get("budget", 0.25), step, boot.get("paths", 2000), boot.get("max_paths", 8000), tuple(boot.get("block_lengths", (10, 20, 40, 60))),
        every=boot.get("rebalance_every", 63), tolerance=boot.get("mc_tolerance", 0.01), strict=boot.get("strict", True), seed=spec.get("seed", 42))
    years = engine.BEAR_YEARS if spec.get("require_china_bear_coverage", True) else ()
    got = evaluation.budget_walk_forward(panel, plan, fold.get("min_train", 752), step, fold.get("train_steps"), fold.get("validation_steps", 0), spec.get("covariance_window", 500),
        rate=spec.get("costs", 1e-4), most_folds=fold.get("max_folds", 20), fallback=fold.get("no_solution_policy", "cash"), value=spec.get("initial_value", 100_000.0), required_years=years)
    sinks.save_evaluation(got, a.output)
    return 0


@command("buy-hold")
def buy_hold(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.config)
    weights = spark.createDataFrame(list(spec["weights"].items()), "asset string, w double")
    path = ledgers.buy_and_hold(sources.read_wide(spark, a.returns, a.kind), weights, float(spec.get("initial_value", 100.0)))
    sources.publish({"path": path}, {"title": "buy_hold"}, a.output, formats={"path": "csv"})
    return 0


POSITION = "position_id string, economic_lot_id string, kind string, amount double, frozen_amount double, node string, security string"
EDGE = "node string, child string, kind string, weight double"
SECURITY = "security string, kind string, issuer string, industry string, duration double, source string"


@command("account-exposure")
def account(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    known, unknown, cash = exposure.account_exposure(_table(spark, spec["positions"], POSITION), _table(spark, spec.get("edges", []), EDGE), _table(spark, spec.get("securities", []), SECURITY))
    rolled = ledgers.rollups(known).unionByName(exposure.root_kinds(_table(spark, spec["positions"], POSITION)))
    told = cash.select(F.lit("cash").alias("level"), F.explode(F.create_map(*(x for n in cash.columns for x in (F.lit(n), F.col(n))))).alias("key", "amount"))
    sinks.save_exposure(known, unknown, rolled.unionByName(told), a.output)
    return 0


@command("convert-lookthrough")
def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    edges = exposure.fund_input(_table(spark, spec["holdings"], "node string, kind string, ident string, weight double"),
        _table(spark, spec.get("securities", []), "ident string, security string"), _table(spark, spec["weights"], "node string, weight double"))
    sources.publish({"edges": edges, "leaves": ledgers.lookthrough(edges, "account")}, {"title": "lookthrough"}, a.output, formats={"edges": "json", "leaves": "json"})
    return 0


def _needs(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """The tables of one account's dated cash needs."""
    told = lambda rows: [{"account": "account", **r} for r in rows]
    return {
        "positions": _table(spark, told(spec["positions"]), "account string, position_id string, kind string, amount double, frozen_amount double"),
        "flows": _table(spark, told(spec["cashflows"]), "account string, id string, kind string, date date, amount double"),
        "releases": _table(spark, told(spec["frozen_releases"]), "account string, id string, position_id string, amount double, date date, condition_met boolean"),
        "sales": _table(spark, told(spec["planned_liquidations"]), "account string, id string, position_id string, book_amount double, trade_date date"),
        "liquidity": _table(spark, told(spec["liquidity"]),
            "account string, position_id string, can_sell boolean, haircut double, fee_rate double, fee_timing string, settlement_days int, settlement_day_basis string, earliest_sale_date date, source string"),
        "scenarios": _table(spark, spec["scenarios"],
            "scenario string, income_multiplier double, income_change_from date, additional_haircut double, settlement_delay_days int, freeze_release_enabled boolean"),
    }


@command("cash-demand")
def needs(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    overrides = _table(spark, spec.get("overrides", []), "scenario string, id string, condition_met boolean")
    sinks.save_demand(*demand.cash_demand(**_needs(spark, spec), start=nav.day(spec["valuation_date"]), end=nav.day(spec["horizon_end"]), overrides=overrides), a.output)
    return 0


@command("observed-cashflow")
def observed(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    rows = _table(spark, spec["valuations"], "owner string, date date, before double, flow double, after double")
    rate = ledgers.xirr_roots(_table(spark, spec["flows"], "owner string, date date, amount double"), "owner")
    sinks.save_review(spec, {"conclusion": "observed account", "result": _rows(ledgers.observed(rows, "owner").join(rate, "owner"))}, a.output)
    return 0


@command("scheduled-cash")
def planned(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    values = _table(spark, spec["nav"], "date date, nav double")
    dates = _table(spark, [{"date": d} for d in spec["planned"]], "date date")
    sources.publish({"path": ledgers.scheduled(values, dates, float(spec["amount"]), float(spec.get("fee", 0.0)), longest=spec.get("max_delay_days"))}, {"title": "scheduled"}, a.output,
        formats={"path": "csv"})
    return 0


@command("exit-cash")
def leaving(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    sinks.save_review(spec, {"conclusion": "exit cash", "result": _rows(ledgers.exit_cash(_table(spark, spec["flows"], "case string, date date, kind string, amount double"), "case"))}, a.output)
    return 0


PANEL = "signal_date date, security string, factor double, fwd double"


@command("factor")
def factor(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    if a.action == "panel":
        found = factors.information(_table(spark, spec["rows"], PANEL), int(spec.get("groups", 5)))
        result = {"dates": _rows(found), "summary": _rows(factors.panel_summary(found))}
    elif a.action == "decay":
        result = {"horizons": _rows(factors.decay(_table(spark, spec["rows"], PANEL + ", horizon int"), spec["horizons"], int(spec.get("groups", 5))))}
    elif a.action == "stability":
        result = {"groups": _rows(factors.stability(_table(spark, spec["rows"], "at date, grp string, ic double")))}
    elif a.action == "exposure":
        result = {"exposure": _rows(factors.exposure(_table(spark, spec["holdings"], "security string, kind string, weight double"), _table(spark, spec["values"], "security string, value double")))}
    elif a.action == "trials":
        result = {"trials": _rows(factors.trial_audit(_table(spark, spec["rows"], "status string, selected boolean, test_touched boolean, train_end date, label_end date, test_start date")))}
    elif a.action == "series":
        rows = _table(spark, spec["rows"], PANEL + ", start date, end date")
        panel = rows.drop("start", "end")
        spans = rows.groupBy("signal_date").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        groups = int(spec.get("groups", 5))
        result = {"dates": _rows(factors.information(panel, groups)), "windows": _rows(factors.overlaps(spans, "signal_date")), "weights": _rows(factors.group_weights(panel, groups))}
    elif a.action in ("cost", "budget"):
        rates = _table(spark, [{"bps": b} for b in spec["bps"]], "bps double")
        periods, trades = _table(spark, spec["periods"], "ix int"), _table(spark, spec["trades"], "ix int, security string, notional double")
        cash = float(spec["cash"])
        path = ledgers.fixed_notional(rates.crossJoin(periods), _table(spark, spec["returns"], "ix int, security string, r double"), trades.crossJoin(rates), cash, "bps", bps=F.col("bps"))
        if a.action == "cost":
            result = {"periods": _rows(path), "drawdown": _rows(ledgers.net_drawdown(path, cash, "bps"))}
        else:
            told = budget.screened(budget.net_returns(path, cash, "bps"), float(spec["limit"]), int(spec["horizon"]), int(spec.get("paths", 200)), float(spec.get("block", 10)),
                int(spec.get("seed", 11)), key="bps")
            result = {"rates": _rows(told)}
    elif a.action == "cashfit":
        tables, span = _needs(spark, spec), {"start": nav.day(spec["valuation_date"]), "end": nav.day(spec["horizon_end"])}
        plans = _table(spark, [{"account": "account", **p} for p in spec["plans"]], "account string, id string, can_trade boolean, date date, amount double")
        extra = plans.select("account", "id", F.lit("necessary_expense").alias("kind"), "date", "amount")
        before, after = demand.cash_demand(**tables, **span)[2], demand.cash_demand(**(tables | {"flows": tables["flows"].unionByName(extra)}), **span)[2]
        result = {"scenarios": _rows(demand.cash_fit(before, after, plans.select("account", "id", "can_trade")))}
    elif a.action == "multi":
        names = [str(n) for n in spec["factors"]]
        rows = _table(spark, spec["rows"], "security string, " + "".join(f"{n} double, " for n in names) + "industry string, market_cap double")
        result = {"scores": _rows(factors.multi_scores(rows, names, {n: float(w) for n, w in spec["weights"].items()}, bool(spec.get("neutralize", True)), bool(spec.get("orthogonalize", False))))}
    else:
        raise InputError(f"unknown action {a.action}")
    sinks.save_review(spec, {"conclusion": f"factor {a.action}", **result}, a.output)
    return 0


BAR = "security string, at timestamp, open double, high double, low double, close double, volume double"


@command("pattern")
def pattern(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    bars = _table(spark, spec["bars"], BAR)
    found = candles.rules(bars)
    tables = {"found": found} if a.action == "identify" else {"study": candles.study(found, bars, [int(h) for h in spec["horizons"]])}
    sources.publish(tables, {"title": f"pattern {a.action}", "input_digest": sources.digest(spec)}, a.output, formats=dict.fromkeys(tables, "json"))
    return 0


def _samples(spark: SparkSession, rows: list[dict], labelled: bool) -> DataFrame:
    bar = "array<struct<open:double,high:double,low:double,close:double,volume:double>>"
    schema = f"id string, security string, signal_at timestamp, history {bar}" + (", y double, available_at timestamp" if labelled else "")
    return _parsed(spark, rows, schema)


def _parsed(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("s")).select("s.*")


@command("cnn")
def cnn(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    labelled = a.action != "predict"
    samples = network.checked_samples(_samples(spark, spec["samples"], labelled), int(spec["lookback"]), labelled=labelled)
    if a.action == "validate":
        sinks.save_review(spec, {"conclusion": "samples are valid", "n": samples.count()}, a.output)
        return 0
    if a.action == "predict":
        scores = network.predict(network.with_channels(samples, bool(spec.get("geometry"))), json.dumps(_json(a.model)))
        sources.publish({"scores": scores}, {"title": "cnn predict", "input_digest": sources.digest(spec)}, a.output, formats={"scores": "json"})
        return 0
    folds = _table(spark, spec["folds"], "fold string, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date")
    staged = lambda g: network.staged_samples(network.with_channels(samples, g), folds, int(spec.get("embargo_days", 0)))
    p = (int(spec.get("epochs", 20)), float(spec.get("rate", 0.01)), int(spec.get("seed", 17)))
    if a.action == "compare":
        last = F.element_at("history", -1)
        tables = {"errors": network.compared(staged(False), staged(True), samples.select("id", F.signum(last["close"] - last["open"]).cast("int").alias("signal")), *p)}
    else:
        fits = network.fit_folds(staged(bool(spec.get("geometry"))), *p)
        tables = {"folds": fits}
    sources.publish(tables, {"title": f"cnn {a.action}", "input_digest": sources.digest(spec)}, a.output, formats=dict.fromkeys(tables, "json"))
    return 0


@command("nav")
def values(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "demo":
        req = {"id": "demo", "source": nav.SOURCE, "fundCode": "000001", "start": "2024-01-01", "end": "2024-12-31", "asOf": "2024-12-31", "currency": nav.CURRENCY,
            "frequency": nav.FREQUENCY, "fields": nav.COLUMNS}
        got, raw = nav.parsed(nav.teaching_response(), req, origin="teaching"), nav.teaching_response()
    elif a.action == "collect":
        got, raw = nav.fetched(_json(a.input), a.online), None
    elif a.action == "replay":
        raw = sources.local_input(a.raw)
        got = nav.replayed(_json(a.input), raw)
    elif a.action == "normalize":
        spec, raw = _json(a.input), None
        got = nav.from_native(spec["native"], spec["request"])
    elif a.action == "validate":
        nav.validate(_json(a.input))
        return 0
    else:
        raise InputError(f"unknown action {a.action}")
    texts = {"snapshot.json": sinks.json_text(got), "request.json": sinks.json_text(got["request"])} | ({"response.js": raw.decode("utf-8-sig")} if raw else {})
    sources.publish({}, {"title": "nav", "record": got["digest"]}, a.output, texts)
    return 0 if got["status"] != "failed" else 2


@command("observations")
def observe(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = _json(a.input)
    rows = _table(spark, spec["rows"], ", ".join(f"{f} string" for f in observations.FIELDS))
    late, unknown = observations.validated(rows, F.to_timestamp(F.lit(spec["asOf"])))
    sinks.save_review({"asOf": spec["asOf"]}, {"conclusion": "the table holds", "excluded": _rows(late), "unknown_availability": _rows(unknown)}, a.output)
    return 0


@command("verify")
def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    sources.frozen(spark, a.input)
    return 0


@command("statistics-demo")
def cases(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.save_review({}, {"conclusion": "what figures can't say", "cases": demo.statistical_cases(spark)}, a.output)
    return 0


@command("doctor")
def doctor(spark: SparkSession, a: argparse.Namespace) -> int:
    """Whether Python workers start and find the library, and where intermediates go."""
    seen = spark.range(2).mapInPandas(lambda it: (b.assign(id=len(demo.ASSETS)) for b in it), "id long").distinct().count()
    print(json.dumps({"spark": spark.version, "workers": seen == 1, "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None), "commands": sorted(COMMANDS)}))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("action", nargs="?", default="")
    for name in ("input", "returns", "config", "factors", "orders", "raw", "model", "output"):
        p.add_argument(f"--{name}")
    p.add_argument("--kind", choices=("returns", "prices"), default="returns")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--online", action="store_true")
    p.add_argument("--auto-name", action="store_true", help="take the next free name if the target exists")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyspark").getOrCreate()
    if a.auto_name and a.output:
        a.output = sources.fresh_name(spark, a.output)
    try:
        return COMMANDS[a.command](spark, a)
    except (InputError, KeyError, TypeError) as e:
        if a.output:
            path = Path(f"{a.output.rstrip('/')}.failure.json")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps({"command": a.command, "error": type(e).__name__, "reason": str(e)}))
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
