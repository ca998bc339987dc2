"""Point-in-time factor review: panels (signal_date, security, factor, fwd), information coefficients, groups, decay, stability, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import beside
from .select import average_ranks


def cutoff(rows: DataFrame, available: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows known at the cut-off, rows that are not, with a reason): late rows are kept apart, never dropped silently."""
    known = F.coalesce(available <= as_of, F.lit(False))
    return rows.where(known), rows.where(~known).withColumn("reason", F.when(available.isNull(), "availability unknown").otherwise("available after the cut-off"))


def lookahead(panel: DataFrame, signal: Column, factor_at: Column, start: Column, end: Column, realised: Column) -> DataFrame:
    """Counts of rows that use what wasn't known: the factor after the signal, a return window not after it, a return realised before its window ends."""
    broken = {"late_factor": factor_at > signal, "early_window": start < signal, "early_return": realised < end}
    return panel.agg(*(F.count_if(c).alias(n) for n, c in broken.items()), F.count("*").alias("n"))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within ``keys``; equal values share their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson's, null where one side doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def ranked(panel: DataFrame, groups: int, *more: str, wide: bool = False) -> DataFrame:
    """``panel`` with fr and yr, the ranks of factor and return on each date, and bucket 1..groups. Ties never split, so a bucket may be empty. A date's securities are sorted in one
    task, or, with ``wide``, spread over tasks by ranges of values: for cross-sections of very many rows. The ranks are the same."""
    keys = ("signal_date", *more)
    if wide:
        sizes = panel.groupBy(*keys).agg(F.count("*").alias("n"))
        out = beside(average_ranks(average_ranks(panel, "factor", "fr", *keys), "fwd", "yr", *keys), sizes, *keys)
    else:
        out = panel.withColumn("fr", average_rank("factor", *keys)).withColumn("yr", average_rank("fwd", *keys)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return out.withColumn("bucket", F.least(F.lit(groups), F.floor((F.col("fr") - 1) * groups / F.col("n")) + 1).cast("int"))


def information(panel: DataFrame, groups: int = 5, *more: str, wide: bool = False) -> DataFrame:
    """Per date: n, ic, rank_ic, spread of the top over the bottom bucket; ``wide`` as in :func:`ranked`."""
    r = ranked(panel, groups, *more, wide=wide)
    mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("fwd")))
    return r.groupBy("signal_date", *more).agg(F.count("*").alias("n"), correlation("factor", "fwd").alias("ic"), correlation("fr", "yr").alias("rank_ic"), (mean(groups) - mean(1)).alias("spread"))


def bucket_returns(panel: DataFrame, groups: int = 5) -> DataFrame:
    return ranked(panel, groups).groupBy("signal_date", "bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("fwd"))


def panel_summary(info: DataFrame, *keys: str) -> DataFrame:
    """Mean rank IC, its sample deviation, their ratio (not annualised), mean spread."""
    out = info.groupBy(*keys).agg(F.count("rank_ic").alias("n_dates"), F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("std_rank_ic"), F.avg("spread").alias("mean_spread"))
    return out.withColumn("icir", F.col("mean_rank_ic") / F.nullif(F.col("std_rank_ic"), F.lit(0.0)))


def group_weights(panel: DataFrame, groups: int = 5) -> DataFrame:
    r = ranked(panel, groups)
    return r.select("signal_date", "security", "bucket", (1 / F.count("*").over(Window.partitionBy("signal_date", "bucket"))).alias("w"))


def overlaps(windows: DataFrame, *ties: str, block: Column | None = None) -> DataFrame:
    """``windows`` (start, end) with overlaps: it starts before an earlier one has ended, in the order of start, end and ``ties``. Every window gives a row, those of the
    same span too. The latest end is carried from block to block, each in a window of its own; ``block``, by default the day of the start, must not fall as
    starts grow, and only one row per block is sorted as a whole."""
    rows = windows.withColumn("__block", F.to_date("start") if block is None else block)
    earlier = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(F.col("__block").alias("__day")).agg(F.max("end").alias("__last")).select("__day", F.max("__last").over(earlier).alias("__carried"))
    before = Window.partitionBy("__block").orderBy("start", "end", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.max("end").over(before)).join(carried, F.col("__block").eqNullSafe(F.col("__day")))
    return rows.select(*(f"`{n}`" for n in windows.columns), F.coalesce(F.col("start") < F.greatest("__own", "__carried"), F.lit(False)).alias("overlaps"))


def decay(panels: DataFrame, horizons: list[int], groups: int = 5) -> DataFrame:
    """Per declared horizon: mean rank IC and spread; a horizon without rows stays as status missing, nothing is interpolated."""
    spark = panels.sparkSession
    declared = spark.range(1).select(F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    means = information(panels, groups, "horizon").groupBy("horizon").agg(F.avg("rank_ic").alias("rank_ic"), F.avg("spread").alias("spread"))
    return declared.join(means, "horizon", "left").withColumn("status", F.when(F.col("rank_ic").isNull(), "missing").otherwise("observed"))


def stability(records: DataFrame, least: int = 2) -> DataFrame:
    """Per group of (at, grp, ic): share of positive ICs, sign flips (a zero breaks the chain), longest run that isn't positive (zero counts), greatest fall
    of the summed IC from its high. A null IC or a record of another group in between breaks runs."""
    every, own = Window.orderBy("at", "grp"), Window.partitionBy("grp").orderBy("at")
    r = records.withColumn("g", F.row_number().over(every)).withColumn("o", F.row_number().over(own))
    r = r.withColumn("cut", (F.col("ic").isNull() | F.lag("ic").over(own).isNull() | (F.col("g") - F.lag("g").over(own) > 1)).cast("int"))
    r = r.withColumn("island", F.sum(F.coalesce("cut", F.lit(1))).over(own.rowsBetween(Window.unboundedPreceding, 0))).where("ic is not null")
    inside = Window.partitionBy("grp", "island").orderBy("at")
    r = r.withColumn("flip", (F.signum("ic") * F.lag(F.signum("ic")).over(inside) < 0).cast("int"))
    r = r.withColumn("run", F.sum((F.col("ic") > 0).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("length", F.sum((F.col("ic") <= 0).cast("int")).over(Window.partitionBy("grp", "island", "run")))
    r = r.withColumn("path", F.sum("ic").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("fall", F.greatest(F.lit(0.0), F.max("path").over(own.rowsBetween(Window.unboundedPreceding, 0))) - F.col("path"))
    out = r.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"),
        F.max("length").alias("longest_non_positive"), F.max("fall").alias("greatest_fall"))
    enough = F.col("n") >= least
    return out.select("grp", "n", *(F.when(enough, F.col(c)).alias(c) for c in ("positive_share", "flips", "longest_non_positive", "greatest_fall")))


def exposure(holdings: DataFrame, values: DataFrame) -> DataFrame:
    """Known, unknown and cash weight; contribution of what is known, normalised exposure, and exposure only if nothing is unknown. Missing values stay unknown."""
    j = holdings.join(values, "security", "left")
    cash, known = F.col("kind") == "cash", (F.col("kind") != "cash") & F.col("value").isNotNull()
    w = F.col("weight")
    out = j.agg(F.sum(F.when(known, w)).alias("known"), F.sum(F.when(~cash & F.col("value").isNull(), w)).alias("unknown"), F.sum(F.when(cash, w)).alias("cash"),
        F.sum(F.when(known, w * F.col("value"))).alias("contribution"))
    return out.select("known", F.coalesce("unknown", F.lit(0.0)).alias("unknown"), F.coalesce("cash", F.lit(0.0)).alias("cash"), "contribution",
        (F.col("contribution") / F.col("known")).alias("normalised"), F.when(F.coalesce("unknown", F.lit(0.0)) <= 1e-12, F.col("contribution")).alias("complete"))


def mid_percentile(universe: DataFrame, target: Column) -> DataFrame:
    """100 times the share of values below the target plus half of those equal to it."""
    return universe.agg(F.avg(F.when(F.col("value") < target, 100.0).when(F.col("value") == target, 50.0).otherwise(0.0)).alias("percentile"))


def neutral_scores(xsec: DataFrame, *keys: str) -> DataFrame:
    """``xsec`` (security, industry, value) with z, the population z-score, and neutral, the z-score of what the industry mean leaves. Means and deviations are aggregates, so a
    cross-section isn't gathered in one task. A null industry is one like others."""
    of = xsec.withColumn("__i", F.coalesce(F.col("industry").cast("string"), F.lit("\0")))

    def joined(df: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
        return df.join(stats, on) if on else df.crossJoin(stats)

    on = list(keys)
    out = joined(of, of.groupBy(*on).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s")), on)
    out = out.withColumn("z", (F.col("value") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))
    out = out.join(out.groupBy(*on, "__i").agg(F.avg("z").alias("__mz")), [*on, "__i"]).withColumn("__rest", F.col("z") - F.col("__mz"))
    out = joined(out, out.groupBy(*on).agg(F.avg("__rest").alias("__mr"), F.stddev_pop("__rest").alias("__sr")), on)
    return out.withColumn("neutral", (F.col("__rest") - F.col("__mr")) / F.nullif(F.col("__sr"), F.lit(0.0))).select(*(f"`{n}`" for n in xsec.columns), "z", "neutral")


def trial_audit(trials: DataFrame) -> DataFrame:
    """Counts by status and of trials whose training reaches into the test, whose labels do, or that touched it."""
    leak = (F.col("train_end") >= F.col("test_start")) | (F.col("label_end") >= F.col("test_start")) | F.col("test_touched")
    return trials.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("selected")).alias("selected"), F.count_if(F.coalesce(leak, F.lit(True))).alias("leaks"))


def prediction_metrics(scores: DataFrame, least: int = 3) -> DataFrame:
    """(signal_date, n, mse, rank_ic) of predictions (signal_date, security, factor, fwd); the rank IC is null for fewer than ``least`` securities."""
    ranked_ = scores.withColumns({"fr": average_rank("factor", "signal_date"), "yr": average_rank("fwd", "signal_date")})
    out = ranked_.groupBy("signal_date").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("factor") - F.col("fwd"), F.lit(2))).alias("mse"), correlation("fr", "yr").alias("ic"))
    return out.select("signal_date", "n", "mse", F.when(F.col("n") >= least, F.col("ic")).alias("rank_ic"))


SCORE = "security string, status string, score double, inflation double, n_used int, n_excluded int"


def multi_scores(rows: DataFrame, names: list[str], weights: dict[str, float], neutralize: bool = True, orthogonalize: bool = False, *keys: str) -> DataFrame:
    """(keys, security, status, score, inflation, n_used, n_excluded) of cross-sections (keys, security, ``names``, industry, market_cap), a cross-section in one task.

    Rows with a missing factor, or control where controls are used, are left out and counted. Factors are standardised, freed of industry and the logarithm of market cap by
    least squares, standardised again, made orthogonal in their declared order if that is asked for, and weighted; the absolute weights sum to 1. ``inflation`` is the largest
    variance inflation. Too few rows, a factor that doesn't vary, or controls that depend on each other give a status and no scores.
    """
    import numpy as np
    import pandas as pd

    from .returns import InputError

    if set(weights) != set(names) or abs(sum(map(abs, weights.values())) - 1) > 1e-8:
        raise InputError("weights for each factor, whose absolute values sum to 1")
    w = np.asarray([weights[n] for n in names])

    def solve(one: pd.DataFrame) -> tuple[pd.DataFrame, str, np.ndarray | None, float | None]:
        need = [*names, *(["industry", "market_cap"] if neutralize else [])]
        used = one.dropna(subset=need).sort_values("security")
        used = used[used["market_cap"] > 0] if neutralize else used
        if len(used) <= len(names) + 5:
            return used, "insufficient_data", None, None
        x = used[names].to_numpy(dtype=float)
        spread = x.std(axis=0)
        if (spread <= 1e-12).any():
            return used, "invalid", None, None
        z = (x - x.mean(axis=0)) / spread
        if neutralize:
            kinds = sorted(used["industry"].unique())
            control = np.column_stack([np.ones(len(used)), np.log(used["market_cap"].to_numpy(dtype=float)), *((used["industry"] == k).to_numpy(dtype=float) for k in kinds[1:])])
            if np.linalg.matrix_rank(control) < control.shape[1] or len(used) <= control.shape[1] + 1:
                return used, "invalid", None, None
            z = z - control @ np.linalg.lstsq(control, z, rcond=None)[0]
            if (z.std(axis=0) <= 1e-12).any():
                return used, "invalid", None, None
            z = z / z.std(axis=0)
        if np.linalg.matrix_rank(np.column_stack([np.ones(len(z)), z])) < len(names) + 1:
            return used, "invalid", None, None
        inflation = float(np.diag(np.linalg.inv(np.corrcoef(z, rowvar=False).reshape(len(names), -1))).max())
        if orthogonalize:
            q, r = np.linalg.qr(z - z.mean(axis=0))
            z = q * np.sign(np.diag(r)) * np.sqrt(len(z))
        return used, "degraded" if inflation > 10 else "ok", z @ w, inflation

    def run(one: pd.DataFrame) -> pd.DataFrame:
        used, status, score, inflation = solve(one)
        left = len(one) - len(used)
        out = pd.DataFrame({"security": used["security"].astype(str), "status": status, "score": score if score is not None else None, "inflation": inflation, "n_used": len(used),
            "n_excluded": left}) if score is not None else pd.DataFrame({"security": [None], "status": [status], "score": [None], "inflation": [None], "n_used": [len(used)], "n_excluded": [left]})
        for k in keys:
            out[k] = one[k].iloc[0]
        return out[[*keys, "security", "status", "score", "inflation", "n_used", "n_excluded"]]

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), SCORE])
    return rows.groupBy(*keys).applyInPandas(run, schema)
