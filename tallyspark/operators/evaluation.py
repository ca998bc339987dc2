"""Evaluation on folds: estimates come from what lies before a fold, the ledger goes on from fold to fold, tests choose nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backtest import Rules, ledgers
from .budget import Budget, detailed_budget
from .returns import InputError, so_far
from .moments import rolling_covariances
from .risk import summary
from .scan import running
from .solve import Limits, allocations

ESTIMATE = "fold int, method string, asset string, w double"


def numbered(panel: DataFrame) -> DataFrame:
    """(date, k): the dates of a panel in order, from 0. A panel's dates are few, its rows are not."""
    return panel.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)


def folds(n: int, least: int, step: int, shortest: int = 10) -> list[tuple[int, int, int]]:
    """(fold, first test row, end) of ``n`` dates from ``least`` on."""
    if least < 30 or step < 10:
        raise InputError("30 dates to learn from and 10 to test on")
    return [(i, a, min(a + step, n)) for i, a in enumerate(range(least, n, step))] if n - least >= shortest else []


def estimates(panel: DataFrame, spans: list[tuple[int, int, int]], limits: Limits | None = None) -> DataFrame:
    """(fold, method, asset, w): allocations on the shrunk covariance of rows ``first`` to ``end`` - 1 for each of ``spans`` (fold, first, end). Covariances come from sums that
    the windows share, and folds are fitted in parallel from a matrix of assets each. A method that fails has one row without an asset."""

    def run(one: pd.DataFrame) -> pd.DataFrame:
        cov = one.pivot(index="i", columns="j", values="v").sort_index()
        cov = cov[cov.index]
        found, failed = allocations(cov.to_numpy(), limits)
        fold = int(one["fold"].iloc[0])
        rows = [(fold, m, a, float(x)) for m, w in found.items() for a, x in zip(cov.index, w)] + [(fold, m, None, None) for m in failed]
        return pd.DataFrame(rows, columns=["fold", "method", "asset", "w"])

    return rolling_covariances(panel, numbered(panel), spans).select("fold", "i", "j", "v").groupBy("fold").applyInPandas(run, ESTIMATE)


def common_methods(estimate: DataFrame, n: int) -> DataFrame:
    """Methods that every fold has."""
    return estimate.groupBy("method").agg(F.countDistinct("fold").alias("n")).where(F.col("n") == n).select("method")


def walk_forward(panel: DataFrame, least: int = 500, step: int = 252, window: int = 500, limits: Limits | None = None, rate: float = 1e-4, periods: float = 252.0) -> tuple[str,
    DataFrame | None, DataFrame | None]:
    """(status, schedule, results): methods are estimated anew before each fold and traded to at its first date, in one ledger for each method that all folds have."""
    dates = numbered(panel).orderBy("k").toPandas()["date"].tolist()
    plan = folds(len(dates), least, step)
    if not plan:
        return "insufficient_data", None, None
    spans = [(f, max(0, a - window), a) for f, a, _ in plan]
    estimate = estimates(panel, spans, limits).where("asset IS NOT NULL").toPandas()  # folds x methods x assets
    if set(estimate["fold"]) != {f for f, _, _ in plan}:
        return "infeasible", None, None
    spark = panel.sparkSession
    table = spark.createDataFrame(estimate, ESTIMATE)
    methods = {r["method"] for r in common_methods(table, len(plan)).collect()}
    first = spark.createDataFrame([(f, dates[a]) for f, a, _ in plan], "fold int, date date")
    schedule = table.where(F.col("method").isin(*methods)).join(F.broadcast(first), "fold").select(F.col("method").alias("path"), "date", "asset", "w")
    test = panel.where(F.col("date") >= F.lit(dates[least])).withColumn("path", F.explode(F.array(*map(F.lit, sorted(methods)))))
    start = {m: Rules(dict(zip(g["asset"], g["w"])), rates=rate, rebalance="quarterly") for m, g in estimate[estimate["fold"] == 0].groupby("method") if m in methods}
    ledger = ledgers(test, start, schedule=schedule)
    paid = ledger.groupBy("path").agg(F.sum("cost").alias("cost"), F.sum("turnover").alias("turnover"))
    status = "ok" if len(methods) == estimate.loc[estimate["fold"] == 0, "method"].nunique() else "degraded"
    return status, schedule, summary(ledger, "path", periods=periods).join(paid, "path")


def complete_years(dates: DataFrame, years: tuple[int, ...], monthly: bool) -> DataFrame:
    """(year, complete): twelve months from January to December, or 200 days from January 10 or before to December 20 or after. Years that aren't there are incomplete."""
    spark = dates.sparkSession
    y = dates.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    daily = (F.col("n") >= 200) & (F.dayofyear("a") <= 10) & (F.date_format("b", "MMdd") >= "1220")
    whole = (F.col("n") == 12) & (F.month("a") == 1) & (F.month("b") == 12) if monthly else daily
    asked = spark.createDataFrame([(x,) for x in years], "year int")
    return asked.join(y, "year", "left").select("year", F.coalesce(whole, F.lit(False)).alias("complete"))


def stitched(parts: DataFrame, *keys: str) -> DataFrame:
    """Ledgers of following folds (keys, date, r, ...) as one: nav is the running product over all of them."""
    return running(parts, *keys, products={"nav": 1 + F.col("r")})


def budget_walk_forward(panel: DataFrame, plan: Budget, least: int = 752, step: int = 126, train: int | None = None, validation: int = 0, window: int = 500, limits: Limits | None = None,
    rate: float = 1e-4, most_folds: int = 20, fallback: str = "cash", flows: DataFrame | None = None, value: float = 100_000.0, required_years: tuple[int, ...] = ()) -> dict:
    """Before each fold candidates are fitted and held to the drawdown budget, the chosen one is traded until the next; without one, cash or the last target. A reference of equal
    weights goes along. What a fold ends with, the next one starts with, so folds follow each other.

    The result has folds (rows), ledger (paths actual and baseline), status counts, and breaches of the budget in whole test windows. ``validation`` dates at the end of the training
    rows are kept for the simulation; fitting doesn't see them. All folds are fitted at once; what follows goes fold by fold, with the returns of one calibration window on the driver,
    which without ``train`` grows with the folds.
    """
    if fallback not in ("cash", "previous_target") or most_folds < 1 or least - validation < 30 or 0 < validation < 30 or (train is not None and train - validation < 30) or plan.horizon != step:
        raise InputError("windows of 30 dates at least, a horizon of one test window, and a known fallback")
    spark = panel.sparkSession
    dates = numbered(panel).orderBy("k").toPandas()["date"].tolist()
    assets = sorted(r["asset"] for r in panel.select("asset").distinct().collect())
    every = folds(len(dates), least, step)
    if not every:
        raise InputError("too few dates for a test")
    paid = {} if flows is None else {r["date"]: float(r["amount"]) for r in flows.collect()}
    if any(d < dates[least] or d not in set(dates) for d in paid):
        raise InputError("flows fall on dates of the tests")
    ends = {p: (value, dict.fromkeys(assets, 0.0)) for p in ("actual", "baseline")}
    last = dict.fromkeys(assets, 0.0)
    told, parts = [], []
    begin = {fold: max(0, a - train) if train else 0 for fold, a, _ in every}
    spans = [(fold, max(begin[fold], a - validation - window), a - validation) for fold, a, _ in every[:most_folds]]
    fits: dict[int, tuple[dict, set]] = {fold: ({}, set()) for fold, *_ in spans}
    for r in estimates(panel, spans, limits).collect():  # folds x methods x assets
        if r["asset"] is None:
            fits[r["fold"]][1].add(r["method"])
        else:
            fits[r["fold"]][0].setdefault(r["method"], dict.fromkeys(assets, 0.0))[r["asset"]] = r["w"]
    for fold, a, b in every[:most_folds]:
        start = a - validation if validation else begin[fold]
        found, failed = {m: np.asarray([w[s] for s in assets]) for m, w in fits[fold][0].items()}, fits[fold][1]
        covered = complete_years(spark.createDataFrame([(d,) for d in dates[start:a]], "date date"), required_years, False) if required_years else None
        if covered is not None and not covered.where("NOT complete").isEmpty():
            status, chosen, table = "insufficient_data", None, []
        elif not found:
            status, chosen, table = "infeasible", None, []
        else:
            own = Budget(**{**vars(plan), "seed": plan.seed + 1009 * fold, "rate": rate, "initial": tuple(ends["actual"][1][s] for s in assets)})
            window_rows = panel.where(F.col("date").between(F.lit(dates[start]), F.lit(dates[a - 1]))).toPandas().pivot(index="date", columns="asset", values="r").sort_index()
            table, chosen, status, _ = detailed_budget(spark, window_rows[assets].to_numpy(), found, own)
        target = dict(zip(assets, found[chosen])) if chosen else last if fallback == "previous_target" else dict.fromkeys(assets, 0.0)
        last = target if chosen else last
        name = next((m for m in ("equal_weight", "constrained_equal_reference") if m in found), None)
        reference = dict(zip(assets, found[name])) if name else dict.fromkeys(assets, 0.0)
        test = panel.where(F.col("date").between(F.lit(dates[a]), F.lit(dates[b - 1]))).withColumn("path", F.explode(F.array(F.lit("actual"), F.lit("baseline"))))
        now = [(d, v) for d, v in paid.items() if dates[a] <= d <= dates[b - 1]]
        rules = {p: Rules({s: float(w) for s, w in t.items()}, ends[p][0], rate, every=plan.every or 0, initial={s: float(w) for s, w in ends[p][1].items()}) for p,
            t in (("actual", target), ("baseline", reference))}
        got = ledgers(test, rules, spark.createDataFrame(now, "date date, amount double") if now else None).toPandas()  # one window of two paths
        got["fold"] = fold
        parts.append(got.drop(columns=["trades"]))
        for p, g in got.sort_values("date").groupby("path"):
            ends[p] = float(g["value"].iloc[-1]), dict(zip(assets, g["weights"].iloc[-1]))
        nav = np.append(1.0, np.cumprod(1 + got[got["path"] == "actual"].sort_values("date")["r"].to_numpy()))
        worst = float((1 - nav / np.maximum.accumulate(nav)).max())
        whole = b - a == step
        told.append({"fold": fold, "test_start": dates[a], "test_end": dates[b - 1], "fit_rows": a - validation - begin[fold], "calibration_rows": a - start, "status": status,
            "selected": chosen, "candidates": len(found), "failed": len(failed), "max_drawdown": worst, "breach": worst > plan.limit if chosen and whole else None, "whole": whole, "baseline": name})
    ledger = spark.createDataFrame(pd.concat(parts)[["path", "date", "fold", "value", "cash", "flow", "cost", "turnover", "r"]],
        "path string, date date, fold int, value double, cash double, flow double, cost double, turnover double, r double")
    eligible = [r["breach"] for r in told if r["breach"] is not None]
    return {"folds": told, "ledger": stitched(ledger, "path"), "complete": len(told) == len(every), "no_solution_rate": sum(r["selected"] is None for r in told) / len(told),
        "breaches": sum(eligible), "eligible": len(eligible), "breach_rate": sum(eligible) / len(eligible) if eligible else None,
            "statuses": pd.Series([r["status"] for r in told]).value_counts().to_dict(), "selections": pd.Series([r["selected"] for r in told if r["selected"]], dtype=object).value_counts().to_dict()}


#: Named spans of falls, as days: fixed values.
STRESS = {"2015_drawdown": ("2015-06-01", "2016-01-31"), "2018": ("2018-01-01", "2018-12-31"), "2020_covid": ("2020-01-01", "2020-03-31"), "2022": ("2022-01-01", "2022-10-31")}


def stress(panel: DataFrame, weights: dict[str, float], spans: dict[str, tuple[str, str]] | None = None, rate: float = 1e-4, periods: float = 252.0) -> DataFrame:
    """A row for each span (scenario): the fixed targets bought at its start, rebalanced by quarters, what they lost by its end, and when the high before was reached again, which
    may be later. A span that the panel doesn't cover up to a week is insufficient_data."""
    spark = panel.sparkSession
    spans = STRESS if spans is None else spans
    if any(a >= b for a, b in spans.values()):
        raise InputError("a span starts before it ends")
    table = spark.createDataFrame([(n, a, b) for n, (a, b) in spans.items()], "path string, start string, end string").select("path", F.col("start").cast("date"), F.col("end").cast("date"))
    seen = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    counted = table.join(F.broadcast(panel.select("date").distinct()), F.col("date").between(F.col("start"), F.col("end")), "left").groupBy("path", "start", "end").agg(F.count("date").alias("rows"))
    told = counted.crossJoin(seen).withColumn("covered", (F.col("rows") >= 2) & (F.col("lo") <= F.date_add("start", 7)) & (F.col("hi") >= F.date_sub("end", 7)))
    rows = panel.join(F.broadcast(told.where("covered").select("path", "start")), F.col("date") >= F.col("start")).select("path", "date", "asset", "r")
    ledger = ledgers(rows, Rules(weights, rates=rate, rebalance="quarterly")).join(F.broadcast(table), "path").select("path", "date", "r", "nav", "cost", "end")
    w = so_far("path")
    path = ledger.withColumn("high", F.greatest(F.lit(1.0), F.max("nav").over(w))).withColumn("fall", 1 - F.col("nav") / F.col("high"))
    inside = path.where("date <= end")
    trough = inside.groupBy("path").agg(F.max(F.struct("fall", (-F.unix_date("date")).alias("k"), "high")).alias("t"), F.sum("cost").alias("cost")).select("path",
        F.date_from_unix_date(-F.col("t.k")).alias("trough"), F.col("t.high").alias("peak"), "cost")
    back = path.join(trough, "path").where("date >= trough AND nav >= peak - 1e-12").groupBy("path").agg(F.min("date").alias("recovered"))
    months = inside.groupBy("path", F.trunc("date", "MM").alias("m")).agg((F.product(1 + F.col("r")) - 1).alias("g")).groupBy("path").agg(F.min("g").alias("worst_month"))
    out = told.select("path", "start", "end", "covered").join(summary(inside, "path", periods=periods), "path", "left").join(trough, "path", "left").join(back, "path", "left").join(months,
        "path", "left")
    status = F.when(~F.col("covered"), "insufficient_data").when(F.col("recovered").isNull(), "right_censored").otherwise("recovered")
    return out.select(F.col("path").alias("scenario"), status.alias("status"), "n", "twr", "max_drawdown", "cost", "worst_month", "trough", "recovered",
        (F.datediff("recovered", "trough") / 30.4375).alias("months"))
