"""The whole run: returns and a configuration in, modules M1 to M7 and a summary out, as DataFrames and small rows.

What is large stays in DataFrames (ledgers, summaries); what is decided by a few assets (allocations, budget, migration) is rows on the driver.
Nothing is selected that the drawdown budget didn't pass: without a solution the reference is named as such and is no recommendation.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import backtest, budget, evaluation, evidence, ledgers, migration, returns, risk, solve
from .operators.returns import InputError

#: Fields of a configuration: fixed values of the contract.
FIELDS = {"data", "periods_per_year", "train_fraction", "costs", "seed", "risk_free_annual", "covariance_window", "min_weight", "max_weight", "groups", "black_litterman", "bootstrap",
    "require_china_bear_coverage", "cashflows", "initial_value", "rebalance", "threshold", "flow_rule", "current_holdings", "current_cash", "new_funds", "locked", "migration_penalty",
        "initial_weights", "walk_forward", "stress"}
BOOTSTRAP = {"budget", "horizon", "paths", "block_lengths", "rebalance_every", "mc_tolerance", "max_paths", "strict"}
BEAR_YEARS = (2015, 2018)


@dataclass
class Report:
    status: str
    reference: str | None
    selected: str | None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, list[dict]] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    conclusions: list[str] = field(default_factory=list)


def _limits(assets: list[str], config: dict) -> solve.Limits:
    n = len(assets)
    wide = lambda v, d: np.broadcast_to(np.asarray(config.get(v, d), dtype=float), (n,)).copy()
    groups = [([assets.index(a) for a in g["assets"]], float(g.get("min", 0)), float(g.get("max", 1))) for g in config.get("groups") or []]
    return solve.Limits(wide("min_weight", 0.0), wide("max_weight", 1.0), groups)


def context(panel: DataFrame, declared: dict, periods: int | None) -> tuple[str, int]:
    """(frequency, periods a year) of dates whose spacing agrees with what is declared."""
    dates = panel.select("date").distinct().withColumn("one", F.lit(1))
    found = returns.frequency(dates, "one").first()["frequency"]
    if found == "irregular" or declared.get("frequency", found) != found:
        raise InputError(f"dates are {found}")
    usual = {"daily": 252, "monthly": 12}[found]
    if periods is not None and (found == "monthly") != (periods == 12):
        raise InputError("periods a year don't fit the dates")
    return found, periods or usual


def _flows(panel: DataFrame, config: dict) -> DataFrame | None:
    paid = config.get("cashflows") or {}
    return panel.sparkSession.createDataFrame([(dt.date.fromisoformat(d), float(a)) for d, a in paid.items()], "date date, amount double") if paid else None


def run(panel: DataFrame, config: dict, factors: DataFrame | None = None, orders: DataFrame | None = None, segments: DataFrame | None = None) -> Report:
    """``panel`` has date, asset and r. ``factors`` (date, asset, r) must have the panel's dates exactly; ``orders`` has date, asset and notional; ``segments`` period, segment, wp, wb, rp
    and rb. The configuration declares data (return_type, source, currency) and may set the fields in ``FIELDS``; others raise."""
    evidence.unknown_fields(config, FIELDS)
    boot = evidence.unknown_fields(dict(config.get("bootstrap") or {}), BOOTSTRAP, "bootstrap")
    data = config.get("data") or {}
    if data.get("return_type") not in ("total_return", "synthetic_total_return") or not data.get("source") or not data.get("currency"):
        raise InputError("declare total returns, their source and one currency")
    returns.checked_returns(panel)
    spark = panel.sparkSession
    assets = sorted(r["asset"] for r in panel.select("asset").distinct().collect())
    kind, periods = context(panel, data, config.get("periods_per_year"))
    fees = config.get("costs", 1e-4)
    seed, free = config.get("seed", 42), config.get("risk_free_annual", 0.0)
    parts = returns.split_by_position(panel, config.get("train_fraction", 0.7))
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    report = Report("degraded", None, None)
    report.warnings.append("fractional amounts and linear costs; no exchange fills, taxes or lots")
    synthetic = data["return_type"] == "synthetic_total_return"

    # M1: candidates from the shrunk covariance of the training rows, which is assets x assets.
    window = config.get("covariance_window", 500)
    recent = evidence.trailing(train, window, "asset").toPandas().pivot(index="date", columns="asset", values="r").sort_index()[assets]
    cov, told = solve.shrunk(recent.to_numpy())
    limits = _limits(assets, config)
    found, failed = solve.allocations(cov, limits)
    report.facts["covariance"] = told
    if told["observations"] < window:
        report.warnings.append("the covariance has fewer rows than asked for")
    if told["shrinkage"] > 0.5 or len(assets) / told["observations"] > 0.1:
        report.warnings.append("the covariance depends on its shrinkage")
    if not found:
        report.status = "infeasible"
        report.rows["M1"] = [{"method": m, "failed": why} for m, why in failed.items()]
        return report
    if views := config.get("black_litterman"):
        if views.get("frequency", "daily") != kind or len(views.get("sources") or []) != len(views["Q"]):
            raise InputError("views need the frequency of the data and a source each")
        delta = views.get("risk_aversion", 3.0)
        mean, predictive = solve.black_litterman(cov, *(np.asarray(views[k], dtype=float) for k in ("market_weights", "P", "Q", "Omega")), views.get("tau", 0.05), delta)
        more, why = solve.allocations(predictive, limits, {"mean": mean, "delta": delta})
        failed |= {f"views:{m}": w for m, w in why.items()}
        if "black_litterman" in more:
            found["black_litterman"] = more["black_litterman"]
    report.rows["M1"] = [{"method": m, "asset": a, "w": float(x)} for m, w in found.items() for a, x in zip(assets, w)] + [{"method": m, "failed": why} for m, why in failed.items()]

    # M2: the drawdown budget on training rows.
    x = train.toPandas().pivot(index="date", columns="asset", values="r").sort_index()[assets].to_numpy()  # dates x assets of one portfolio
    plan = budget.Budget(boot.get("budget", 0.25), boot.get("horizon", 252), boot.get("paths", 2000), boot.get("max_paths", 8000), tuple(boot.get("block_lengths", (10, 20, 40, 60))),
        float(np.max(fees if not isinstance(fees, dict) else list(fees.values()))), boot.get("rebalance_every", 63), boot.get("mc_tolerance", 0.01), boot.get("strict", True), seed, periods)
    table, selected, status, blocks = budget.detailed_budget(spark, x, found, plan)
    covered = evaluation.complete_years(train.select("date").distinct(), BEAR_YEARS, kind == "monthly")
    if config.get("require_china_bear_coverage", True) and not covered.where("NOT complete").isEmpty():
        status, report.facts["exploratory"], selected = "insufficient_data", selected, None
        report.warnings.append("training rows don't cover 2015 and 2018: no candidate is approved")
    if synthetic and selected:
        status = "degraded"
    report.rows["M2"], report.facts["budget_status"], report.facts["frontier"] = table, status, budget.frontier(table)
    report.rows["M2_blocks"] = [{"candidate": m, **b} for m, rows in blocks.items() for b in rows]
    report.selected = selected
    reference = report.reference = selected or next(iter(found))
    weights = {m: dict(zip(assets, map(float, w))) for m, w in found.items()}

    # Ledgers of all candidates over all dates and over the held-out ones, and of the reference with flows.
    flows = _flows(panel, config)
    value = float(config.get("initial_value", 100_000))
    paths = F.explode(F.array(*map(F.lit, found)))
    rules = {m: backtest.Rules(w, rates=fees, rebalance="quarterly") for m, w in weights.items()}
    whole = backtest.ledgers(panel.withColumn("path", paths), rules)
    held = backtest.ledgers(test.withColumn("path", paths), rules)
    costs = lambda ledger: ledger.groupBy("path").agg(F.sum("cost").alias("cost"))
    report.tables["historical"] = risk.summary(whole, "path", periods=periods, risk_free=free).join(costs(whole), "path")
    report.tables["held_out"] = risk.summary(held, "path", periods=periods, risk_free=free).join(costs(held), "path")
    rule = lambda **more: backtest.Rules(weights[reference], value, fees, flow_rule=config.get("flow_rule", "target"), **more)
    declared = config.get("rebalance", "quarterly")
    own = {"threshold": {"threshold": config.get("threshold", 0.2)}}.get(declared, {"rebalance": declared})
    three = {"reference": rule(**own), "quarterly": rule(rebalance="quarterly"), "threshold": rule(threshold=config.get("threshold", 0.2))}
    ledger = backtest.ledgers(panel.withColumn("path", F.explode(F.array(*map(F.lit, three)))), three, flows)
    report.tables["ledger"] = ledger.where("path = 'reference'").drop("trades")
    report.tables["transactions"] = backtest.transactions(ledger.where("path = 'reference'"), assets)
    report.tables["rebalancing"] = risk.summary(ledger, "path", periods=periods, risk_free=free).join(costs(ledger), "path")

    # M3: attribution.
    main = report.tables["ledger"]
    if segments is not None:
        report.tables["brinson"] = ledgers.brinson(segments)
        report.tables["brinson_linked"] = ledgers.brinson_linked(report.tables["brinson"])
    if factors is not None:
        rest = factors.select("date").distinct()
        if not returns.calendar_gaps(rest, panel.select("date")).isEmpty():
            raise InputError("factor dates must be the panel's dates exactly")
        per = (1 + free) ** (1 / periods) - 1
        excess = main.select("date", (F.col("r") - per).alias("y"))
        report.rows["factor_regression"] = solve.hac_rows(excess, factors)

    # M4: from what is held to the reference.
    if "current_holdings" in config:
        now = np.asarray([float(config["current_holdings"][a]) for a in assets])
        rates = np.asarray([fees[a] for a in assets]) if isinstance(fees, dict) else fees
        report.rows["M4"] = []
        for mode in migration.MODES:
            got = migration.plan(now, found[reference], config.get("current_cash", 0.0), config.get("new_funds", 0.0), rates, tuple(assets.index(a) for a in config.get("locked") or ()),
                mode, config.get("migration_penalty", 1.0))
            if got["status"] == "ok":
                after = got["holdings"] / (got["holdings"].sum() + got["cash"])
                got |= {"final_volatility": float(np.sqrt(after @ cov @ after * periods)), "target_volatility": float(np.sqrt(found[reference] @ cov @ found[reference] * periods))}
            report.rows["M4"].append(got)

    # M5: named falls; M6: what trades did; M7: the reference's risk.
    report.tables["stress"] = evaluation.stress(panel, weights[reference], config.get("stress"), float(np.max(fees)) if not isinstance(fees, dict) else max(fees.values()), periods)
    if orders is not None:
        base = backtest.Rules(config.get("initial_weights") or weights[reference], value, fees)
        report.tables["counterfactual"], report.tables["trade_difference"] = backtest.counterfactual(panel, base, orders, flows)
    report.tables["risk"] = risk.summary(main, "path", periods=periods, risk_free=free)
    report.tables["tail"] = risk.expected_shortfall(main.select("path", "date", "r"), "path", alpha=0.95).unionByName(risk.expected_shortfall(main.select("path", "date", "r"), "path", alpha=0.90))
    report.tables["irr"] = ledgers.xirr_roots(backtest.investor_flows(main, value), "path")
    n = main.count()
    report.facts["sharpe"] = budget.sharpe_interval(main.select("date", "r"), seed=seed, periods=periods, risk_free=free)
    report.facts["holding"] = {y: risk.rolling_holding(main.select("path", "date", "r"), int(y * periods), float(y), "path") for y in budget.YEARS if n >= y * periods}
    forward = evidence.unknown_fields(dict(config.get("walk_forward") or {}), {"min_train", "test_steps"}, "walk_forward")
    report.facts["walk_forward"], _, report_table = evaluation.walk_forward(panel, forward.get("min_train", 500), forward.get("test_steps", 252), window, limits, plan.rate, periods)
    if report_table is not None:
        report.tables["walk_forward"] = report_table
    report.rows["decision"] = decision(report, synthetic)
    report.conclusions = [r["text"] for r in report.rows["decision"]]
    return report


def comparison(results: DataFrame, baseline: str) -> DataFrame:
    """(path, gain, reduction, label): how each path's annual return and largest drawdown differ from the baseline's."""
    base = results.where(F.col("path") == baseline).select(F.col("cagr").alias("b"), F.col("max_drawdown").alias("d"))
    gain, less = F.col("cagr") - F.col("b"), F.col("d") - F.col("max_drawdown")
    return results.join(F.broadcast(base)).select("path", gain.alias("gain"), less.alias("reduction"), evidence.tradeoff(gain, less, F.col("path") == baseline).alias("label"))


def decision(report: Report, synthetic: bool = False) -> list[dict]:
    """Plain statements of what a report says and what it doesn't, each with the module it comes from."""
    out: list[dict] = []
    say = lambda module, text: out.append({"module": module, "text": text})
    if synthetic:
        say("data", "The returns are synthetic: results check the arithmetic and say nothing about markets.")
    if report.selected:
        row = next(r for r in report.rows["M2"] if r["candidate"] == report.selected)
        top = max(b["high"] for b in report.rows["M2_blocks"] if b["candidate"] == report.selected)
        say("M2", f"{report.selected} keeps the declared drawdown budget: worst p95 {row['worst_p95']:.2%}, upper end of the simulation's interval {top:.2%}. This is no guarantee.")
    else:
        say("M2", "No allocation passed the drawdown budget; weights and trades shown are comparisons only.")
    names = [r["method"] for r in report.rows["M1"] if "w" in r]
    baseline = next((m for m in ("equal_weight", "constrained_equal_reference") if m in names), None)
    if report.selected and baseline and report.selected != baseline and "held_out" in report.tables:
        row = comparison(report.tables["held_out"], baseline).where(F.col("path") == report.selected).first()
        say("held_out", f"Against {baseline} on held-out dates: annual return {row['gain']:+.2%}, drawdown {-row['reduction']:+.2%} ({row['label']}); one window, no proof of persistence.")
    for plan in report.rows.get("M4", []):
        if plan["status"] == "ok" and plan["mode"] != "one_step" and not plan["target_reached"]:
            say("M4", f"{plan['mode']} leaves a gap of up to {plan['max_gap']:.2%} from the target: executable is not the same as reached.")
            break
    interval = report.facts.get("sharpe", {}).get("interval")
    if interval is not None and interval[0] <= 0 <= interval[1]:
        say("M7", "The Sharpe interval includes zero: the sample gives no evidence of a steady advantage.")
    return out
