"""Made inputs for trying things out, and counter-examples that show what a figure can't say. All of it is seeded and says that it is synthetic."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shock windows as shares of the history, with the daily drift they add.
SHOCKS = ((0.15, 0.20, -0.006), (0.45, 0.49, -0.009), (0.75, 0.80, -0.005))
ASSETS = ("bond", "gold", "stock_a", "stock_b")


def returns(seed: int = 42, days: int = 1500, start: str = "2014-01-02") -> list[tuple[dt.date, str, float]]:
    """(date, asset, r) of four correlated assets on weekdays with three falls of the stocks."""
    rng = np.random.default_rng(seed)
    vol = np.asarray([0.002, 0.008, 0.012, 0.014])
    corr = np.asarray([[1, 0.1, -0.2, -0.2], [0.1, 1, 0, 0], [-0.2, 0, 1, 0.7], [-0.2, 0, 0.7, 1]])
    x = rng.normal(size=(days, 4)) @ np.linalg.cholesky(corr).T * vol + np.asarray([0.0001, 0.0001, 0.0004, 0.0004])
    for a, b, drift in SHOCKS:
        x[int(a * days) : int(b * days), 2:] += drift
    dates = np.busday_offset(start, np.arange(days), roll="forward").astype(dt.date)
    return [(d, asset, float(np.clip(r, -0.5, 0.5))) for d, row in zip(dates, x) for asset, r in zip(ASSETS, row)]


def panel(spark: SparkSession, seed: int = 42, days: int = 1500) -> DataFrame:
    return spark.createDataFrame(returns(seed, days), "date date, asset string, r double")


def factors(spark: SparkSession, seed: int = 42, days: int = 1500) -> DataFrame:
    """A market and a rate factor on the panel's dates, from its assets and noise."""
    p = panel(spark, seed, days).groupBy("date").pivot("asset", list(ASSETS)).agg(F.first("r"))
    noise = F.randn(seed) * 0.001
    told = p.select("date", (0.5 * F.col("stock_a") + 0.5 * F.col("stock_b") + noise).alias("market"), (F.col("bond") + noise).alias("rate"))
    return told.unpivot("date", ["market", "rate"], "asset", "r")


def config(seed: int = 42, fast: bool = True) -> dict:
    """A configuration that goes with :func:`panel`; ``fast`` simulates fewer paths."""
    paths = {"paths": 250, "max_paths": 500, "block_lengths": [10, 20]} if fast else {}
    return {"data": {"return_type": "synthetic_total_return", "source": "made", "currency": "CNY"}, "seed": seed, "costs": 0.0005, "require_china_bear_coverage": False,
        "bootstrap": {"budget": 0.3, "mc_tolerance": 0.05, **paths}, "current_holdings": {"bond": 20_000, "gold": 5_000, "stock_a": 60_000, "stock_b": 15_000},
            "walk_forward": {"min_train": 500, "test_steps": 252}}


def bars(spark: SparkSession, seed: int = 17, securities: int = 4, days: int = 60) -> DataFrame:
    """(security, at, open, high, low, close, volume) of seeded walks."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(securities):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.01, days)))
        open_ = close * np.exp(rng.normal(0, 0.005, days))
        for k in range(days):
            high, low = max(open_[k], close[k]) * 1.004, min(open_[k], close[k]) * 0.996
            rows.append((f"T{s}", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(open_[k]), float(high), float(low), float(close[k]), float(1000 + rng.integers(0, 500))))
    return spark.createDataFrame(rows, "security string, at timestamp, open double, high double, low double, close double, volume double")


def repeated_selection(spark: SparkSession, trials: int = 200, days: int = 250, seed: int = 5) -> DataFrame:
    """(trials, best, mean): annual Sharpe ratios of candidates without any skill. The best of many looks good by chance alone."""
    noise = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    u = lambda t: (F.abs(F.xxhash64("trial", "day", F.lit(seed), F.lit(t))) % 1_000_003 + 1) / F.lit(1_000_004.0)
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * np.pi * u("b"))
    each = noise.withColumn("r", normal * 0.01).groupBy("trial").agg((F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return each.agg(F.count("*").alias("trials"), F.max("sharpe").alias("best"), F.avg("sharpe").alias("mean"))


def statistical_cases(spark: SparkSession) -> list[dict]:
    """Cases that a reader should know: a tail of few rows, the best of many trials, a test that a choice has touched."""
    from .operators.factors import trial_audit
    from .operators.risk import expected_shortfall

    short = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=k), -0.001 * (k % 7)) for k in range(60)], "date date, r double").withColumn("path", F.lit("short"))
    tail = expected_shortfall(short, "path").first()
    best = repeated_selection(spark).first()
    day = lambda k: dt.date(2024, 1, k)
    audit = trial_audit(spark.createDataFrame([("done", True, True, day(1), day(2), day(3)), ("done", False, False, day(1), day(2), day(3))],
        "status string, selected boolean, test_touched boolean, train_end date, label_end date, test_start date")).first()
    return [
        {"case": "sparse_tail", "status": tail["status"], "figure": tail["es"], "says": "an expected shortfall of three rows is no estimate"},
        {"case": "repeated_selection", "status": "biased" if best["best"] > 1 else "ok", "figure": best["best"],
            "says": f"the best of {best['trials']} trials without skill; their mean is {best['mean']:.2f}"},
        {"case": "test_isolation", "status": "broken" if audit["leaks"] else "ok", "figure": float(audit["leaks"]), "says": "a trial that has touched its test tests nothing"},
    ]
