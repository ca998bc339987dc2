"""Covariances of many windows over one panel, from sums that windows share.

The borders of all windows cut the dates into blocks; each block's sums of products up to the fourth order are added up once, for each pair of assets, and a window's are the sum
of its blocks'. So a row is read once, however many windows it lies in, and what follows has as many rows as windows times pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POWERS = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2))


def rolling_covariances(panel: DataFrame, numbered: DataFrame, spans: list[tuple[int, int, int]], shrink: bool = True) -> DataFrame:
    """(fold, i, j, v, n, shrinkage): population covariances of ``panel`` (date, asset, r) over rows ``first`` to ``end`` - 1 of ``numbered`` (date, k), for each of ``spans`` (fold,
    first, end); shrunk to the mean variance times the unit matrix as in :func:`tallyspark.operators.risk.ledoit_wolf`. Spans are few, they are literals of the plan."""
    bounds = sorted({b for _, *ends in spans for b in ends})
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("k")))
    rows = panel.join(numbered, "date").select("date", "asset", "r", block.alias("block"))
    a, b = rows.select("date", "block", F.col("asset").alias("i"), F.col("r").alias("x")), rows.select("date", F.col("asset").alias("j"), F.col("r").alias("y"))
    term = lambda p, q: F.pow("x", F.lit(p)) * F.pow("y", F.lit(q))
    blocks = a.join(b, "date").groupBy("i", "j", "block").agg(*(F.sum(term(p, q)).alias(f"s{p}{q}") for p, q in POWERS))
    at = {b: k for k, b in enumerate(bounds)}
    folds = panel.sparkSession.createDataFrame([(f, at[first], at[end]) for f, first, end in spans], "fold int, low int, high int")
    sums = blocks.join(F.broadcast(folds), (F.col("block") > F.col("low")) & (F.col("block") <= F.col("high"))).groupBy("fold", "i", "j").agg(*(F.sum(f"s{p}{q}").alias(f"s{p}{q}") for p, q in POWERS))
    n, s = F.col("s00"), {(p, q): F.col(f"s{p}{q}") for p, q in POWERS}
    m, k = s[1, 0] / n, s[0, 1] / n
    v = s[1, 1] / n - m * k
    fourth = s[2, 2] - 2 * k * s[2, 1] + k * k * s[2, 0] - 2 * m * s[1, 2] + 4 * m * k * s[1, 1] - 2 * m * k * k * s[1, 0] + m * m * s[0, 2] - 2 * m * m * k * s[0, 1] + m * m * k * k * n
    each = sums.select("fold", "i", "j", n.cast("long").alias("n"), v.alias("v"), (fourth / n).alias("q"))
    if not shrink:
        return each.select("fold", "i", "j", "v", "n", F.lit(0.0).alias("shrinkage"))
    own = Window.partitionBy("fold")
    same = (F.col("i") == F.col("j")).cast("double")
    p = F.sqrt(F.count("*").over(own).cast("double"))
    mean = F.sum(same * F.col("v")).over(own) / p
    each = each.withColumns({"p": p, "mean": mean}).withColumn("d", F.col("v") - same * F.col("mean"))
    apart = F.sum(F.col("d") * F.col("d")).over(own) / F.col("p")
    noise = F.greatest(F.lit(0.0), F.sum(F.col("q") - F.col("v") * F.col("v")).over(own)) / (F.col("n") * F.col("p"))
    each = each.withColumns({"apart": apart, "noise": noise})
    weight = F.when(F.col("apart") > 0, F.least("noise", "apart") / F.nullif(F.col("apart"), F.lit(0.0))).otherwise(0.0)
    each = each.withColumn("shrinkage", weight)
    return each.select("fold", "i", "j", ((1 - F.col("shrinkage")) * F.col("v") + same * F.col("shrinkage") * F.col("mean")).alias("v"), "n", "shrinkage")
