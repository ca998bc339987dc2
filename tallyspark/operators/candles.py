"""Candle metrics, rules and studies on bars (security, at, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def own() -> Window:
    return Window.partitionBy("security").orderBy("at")


def metrics(bars: DataFrame) -> DataFrame:
    """``bars`` with span, body, upper, lower, body_ratio (null without a span) and sign."""
    top, low = F.greatest("open", "close"), F.least("open", "close")
    return bars.withColumns({"span": F.col("high") - F.col("low"), "body": F.abs(F.col("close") - F.col("open")), "upper": F.col("high") - top, "lower": low - F.col("low"),
        "sign": F.signum(F.col("close") - F.col("open"))}).withColumn("body_ratio", F.col("body") / F.nullif(F.col("span"), F.lit(0.0)))


def rules(bars: DataFrame, trend: int = 3, doji: float = 0.1, small: float = 0.3, long: float = 0.6, shadow: float = 2.0) -> DataFrame:
    """(security, at, pattern, direction, matched, context, status) of eleven patterns for each bar. Shape and the trend before it are told apart: a shape whose
    trend can't be known has status context-unknown."""
    m = metrics(bars)
    w = own()
    lag = lambda c, k: F.lag(c, k).over(w)
    for k in (1, 2):
        m = m.withColumns({f"{c}{k}": lag(c, k) for c in ("open", "close", "body", "body_ratio", "sign")})
    for n in (1, 2, 3):
        m = m.withColumn(f"t{n}", lag("close", n) / lag("close", n + trend - 1) - 1)
    c = F.col
    hammer = (c("body_ratio") <= small) & (c("lower") >= shadow * c("body")) & (c("upper") <= c("body")) & (c("body") > 0)
    star = (c("body_ratio") <= small) & (c("upper") >= shadow * c("body")) & (c("lower") <= c("body")) & (c("body") > 0)
    covers = (F.greatest("open", "close") >= F.greatest("open1", "close1")) & (F.least("open", "close") <= F.least("open1", "close1")) & (c("body") > c("body1"))
    top1, low1 = F.greatest("open1", "close1"), F.least("open1", "close1")
    half2 = (c("open2") + c("close2")) / 2
    three = lambda s: (c("sign") == s) & (c("sign1") == s) & (c("sign2") == s) & (c("body_ratio") >= long) & (c("body_ratio1") >= long) & (c("body_ratio2") >= long) & (s * (c("close") - c("close1")) > 0) & (s * (c("close1") - c("close2")) > 0)
    up, down, any_trend = (lambda t: t > 0), (lambda t: t < 0), (lambda t: F.lit(True))
    table: list[tuple[str, int, Column, Column, object]] = [
        ("doji", 0, c("body_ratio") <= doji, c("t1"), any_trend),
        ("hammer", 1, hammer, c("t1"), down),
        ("hanging_man", -1, hammer, c("t1"), up),
        ("inverted_hammer", 1, star, c("t1"), down),
        ("shooting_star", -1, star, c("t1"), up),
        ("bullish_engulfing", 1, (c("sign1") < 0) & (c("sign") > 0) & covers, c("t2"), down),
        ("bearish_engulfing", -1, (c("sign1") > 0) & (c("sign") < 0) & covers, c("t2"), up),
        ("morning_star", 1, (c("sign2") < 0) & (c("body_ratio2") >= long) & (c("body_ratio1") <= small) & (top1 < c("close2")) & (c("sign") > 0) & (c("close") > half2) & (c("open") > top1),
            c("t3"), down),
        ("evening_star", -1, (c("sign2") > 0) & (c("body_ratio2") >= long) & (c("body_ratio1") <= small) & (low1 > c("close2")) & (c("sign") < 0) & (c("close") < half2) & (c("open") < low1),
            c("t3"), up),
        ("three_white_soldiers", 1, three(1), c("t3"), down),
        ("three_black_crows", -1, three(-1), c("t3"), up),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("pattern"), F.lit(d).alias("direction"), F.coalesce(shape, F.lit(False)).alias("matched"),
        (F.lit(True) if test is any_trend else test(t)).alias("context")) for n, d, shape, t, test in table))
    out = m.select("security", "at", F.explode(rows).alias("p")).select("security", "at", "p.*")
    status = F.when(~F.col("matched"), "not-matched").when(F.col("context").isNull(), "context-unknown").when(F.col("context"), "matched").otherwise("context-not-matched")
    return out.withColumn("status", status)


def signal(found: DataFrame) -> DataFrame:
    """(security, at, signal): sign of the sum of directions of matched patterns."""
    return found.groupBy("security", "at").agg(F.signum(F.sum(F.when(F.col("status") == "matched", F.col("direction")).otherwise(0))).cast("int").alias("signal"))


def study(found: DataFrame, bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Per pattern and horizon: returns after matches. All pairs stand, those without matches too."""
    ahead = bars.select("security", "at", F.array(*(F.lead("close", h).over(own()) / F.col("close") - 1 for h in horizons)).alias("ys")).select("security", "at", F.posexplode("ys").alias("k", "y"))
    ahead = ahead.withColumn("horizon", F.element_at(F.array(*map(F.lit, horizons)), F.col("k") + 1)).where("y is not null")
    hits = found.where("status = 'matched'").join(ahead, ["security", "at"]).groupBy("pattern", "horizon").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.percentile("y", F.lit(0.5)).alias("median"), F.avg((F.col("y") > 0).cast("double")).alias("positive"),
        F.avg(F.when(F.col("direction") != 0, (F.signum("y") == F.signum("direction")).cast("double"))).alias("aligned"), F.min("y").alias("worst"), F.max("y").alias("best"),
    )
    pairs = found.select("pattern").distinct().select("pattern", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    return pairs.join(hits, ["pattern", "horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def geometry(bars: DataFrame) -> DataFrame:
    """Causal channels of each bar: body, upper and lower shadow over the close, gap to the close before, change over two bars."""
    m, w = metrics(bars), own()
    last = F.lag("close").over(w)
    return m.select("security", "at", ((F.col("close") - F.col("open")) / F.col("close")).alias("body"), (F.col("upper") / F.col("close")).alias("upper"),
        (F.col("lower") / F.col("close")).alias("lower"), (F.col("open") / last - 1).alias("gap"), (F.col("close") / F.lag("close", 2).over(w) - 1).alias("change2"))


def purged_splits(samples: DataFrame, stages: list[tuple[str, str, str]], embargo_days: int) -> DataFrame:
    """``samples`` (id, signal_at, available_at) with stage and purged: a row whose label is available at or after the next stage's start less the embargo."""
    stage = F.coalesce(*(F.when(F.col("signal_at").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")), n) for n, a, b in stages))
    nxt = F.coalesce(*(F.when(F.col("stage") == a[0], F.lit(b[1]).cast("timestamp")) for a, b in zip(stages, stages[1:])), F.lit(None).cast("timestamp"))
    out = samples.withColumn("stage", stage).where("stage is not null")
    return out.withColumn("purged", F.coalesce(F.col("available_at") >= nxt - F.expr(f"interval {embargo_days} days"), F.lit(False)))


def scaler(values: DataFrame) -> DataFrame:
    """(channel, mean, std) of (channel, v) by population deviation; a channel that doesn't vary has 1."""
    return values.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("s")).select("channel", "mean", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("std"))


def rule_mapping(train: DataFrame) -> DataFrame:
    """Mean label for each signal -1, 0, 1 of (signal, y); a signal that training lacks gets the mean of all."""
    spark = train.sparkSession
    whole = train.agg(F.avg("y").alias("overall"))
    signals = spark.range(-1, 2).select(F.col("id").cast("int").alias("signal"))
    means = train.groupBy("signal").agg(F.avg("y").alias("own"))
    return signals.join(means, "signal", "left").join(F.broadcast(whole)).select("signal", F.coalesce("own", "overall").alias("y"))


def event_study(found: DataFrame, outcomes: DataFrame, horizons: list[int], patterns: list[str]) -> DataFrame:
    """Per pattern and horizon, all pairs, those without events too: n, mean, median, positive share, share in the pattern's direction (null for none), worst, best, mean excess over the
    benchmark, how many benchmarks are known and missing, how many events are blocked or unknown to trade, and the first ids.

    ``found`` has id, pattern, direction and execution (see :func:`tallyspark.operators.evidence.execution_status`); ``outcomes`` id, horizon, y and benchmark, which may be null."""
    spark = found.sparkSession
    cells = spark.createDataFrame([(p, h) for p in patterns for h in horizons], "pattern string, horizon int")
    rows = found.join(outcomes, "id")
    excess = F.col("y") - F.col("benchmark")
    along = F.when(F.col("direction") != 0, (F.signum("y") == F.signum("direction")).cast("double"))
    out = rows.groupBy("pattern", "horizon").agg(
        F.count("*").alias("n"),
        F.avg("y").alias("mean"),
        F.percentile("y", F.lit(0.5)).alias("median"),
        F.avg((F.col("y") > 0).cast("double")).alias("positive"),
        F.avg(along).alias("aligned"),
        F.min("y").alias("worst"),
        F.max("y").alias("best"),
        F.avg(excess).alias("excess"),
        F.count("benchmark").alias("with_benchmark"),
        F.count_if(F.col("benchmark").isNull()).alias("without_benchmark"),
        F.count_if(F.col("execution") == "blocked").alias("blocked"),
        F.count_if(F.col("execution") == "unknown").alias("unknown"),
        F.min("id").alias("first_id"),
    )
    return cells.join(out, ["pattern", "horizon"], "left").fillna(0, ["n", "with_benchmark", "without_benchmark", "blocked", "unknown"])


def omitted_horizons(outcomes: DataFrame, horizons: list[int]) -> DataFrame:
    """(id, omitted): declared horizons that an id has no outcome for."""
    seen = outcomes.groupBy("id").agg(F.collect_set("horizon").alias("seen"))
    return seen.select("id", F.array_except(F.array(*(F.lit(h) for h in horizons)), "seen").alias("omitted"))


def first_groups(study: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` cells that have events, by name and horizon: an order for reading, not a ranking."""
    return study.where("n > 0").orderBy("pattern", "horizon").limit(n)
