"""Prices, returns, net asset values and their alignment, on long tables (date, asset, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running


class InputError(ValueError):
    """Input that breaks its contract."""


def require(df: DataFrame, **violations: Column) -> DataFrame:
    """``df`` if no row breaks a rule; all rules are counted in one job. A violation that is null counts as broken."""
    found = df.agg(*(F.count_if(F.coalesce(v, F.lit(True))).alias(n) for n, v in violations.items())).first().asDict()
    if broken := {n: c for n, c in found.items() if c}:
        raise InputError(f"rows that break a rule: {broken}")
    return df


def few(df: DataFrame, what: str, most: int = 1_000) -> DataFrame:
    """``df`` with a hint to broadcast it, after a look at its size: more than ``most`` rows raise."""
    if df.limit(most + 1).count() > most:
        raise InputError(f"more than {most} {what}")
    return F.broadcast(df)


def by_date(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def so_far(*keys: str) -> Window:
    return by_date(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def pct_change(prices: DataFrame) -> DataFrame:
    """(date, asset, r) from (date, asset, px); each asset's first row has no return and goes."""
    return prices.withColumn("r", F.col("px") / F.lag("px").over(by_date("asset")) - 1).where("r is not null").select("date", "asset", "r")


def checked_returns(returns: DataFrame) -> DataFrame:
    """Returns that are finite, above -1 and unique by date and asset, with every asset on every date; else InputError."""
    require(returns, not_finite=F.isnan("r") | F.col("r").isNull() | (F.abs("r") == float("inf")), total_loss=F.col("r") <= -1)
    n = returns.agg(F.count("*").alias("n"), F.countDistinct("date").alias("d"), F.countDistinct("asset").alias("a"), F.countDistinct("date", "asset").alias("u")).first()
    if n["n"] == 0 or n["n"] != n["u"] or n["n"] != n["d"] * n["a"]:
        raise InputError("a return panel needs each asset once on each date")
    return returns


def common_dates(values: DataFrame) -> DataFrame:
    """Rows of dates on which every asset has one: what must be asked for, as panels are never joined by intersection silently."""
    assets = values.agg(F.countDistinct("asset").alias("assets"))
    dates = values.groupBy("date").agg(F.countDistinct("asset").alias("n")).join(assets, F.col("n") == F.col("assets")).select("date")
    return values.join(dates, "date", "left_semi")


def total_return_index(nav: DataFrame, events: DataFrame) -> DataFrame:
    """(code, date, nav, index): cash per old unit is reinvested on its day, splits multiply units; an event on a day without nav raises."""
    unique_rows(nav, "code", "date")
    unique_rows(events, "code", "date")
    if not events.join(nav, ["code", "date"], "left_anti").isEmpty():
        raise InputError("an event falls on a date without nav")
    first_day = nav.groupBy("code").agg(F.min("date").alias("date"))
    if not events.join(first_day, ["code", "date"], "left_semi").isEmpty():
        raise InputError("an event falls on the first date, before which nothing was held")
    joined = nav.join(events, ["code", "date"], "left")
    grown = running(joined, "code", products={"units": F.coalesce("split", F.lit(1.0)) + F.coalesce("cash", F.lit(0.0)) / F.col("nav")})
    base = nav.groupBy("code").agg(F.min_by("nav", "date").alias("base"))
    return grown.join(base, "code").select("code", "date", "nav", (F.col("units") * F.col("nav") / F.col("base")).alias("index"))


def premium(prices: DataFrame, nav: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((date, premium) where both are known, dates of prices without nav)."""
    return prices.join(nav, "date").select("date", (F.col("close") / F.col("nav") - 1).alias("premium")), prices.join(nav, "date", "left_anti").select("date")


def calendar_gaps(observed: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, kind): dates of the calendar that are missing and observed dates that it doesn't have."""
    missing = calendar.select("date").distinct().join(observed, "date", "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(observed.select("date").distinct().join(calendar, "date", "left_anti").withColumn("kind", F.lit("unexpected")))


def frequency(dates: DataFrame, *keys: str) -> DataFrame:
    """Observation frequency by date spacing: monthly if each month follows the last, daily if the median gap is at most 4 and the largest at most 14 days."""
    w = by_date(*keys)
    month = F.year("date") * 12 + F.month("date")
    gaps = dates.withColumn("gap", F.datediff("date", F.lag("date").over(w))).withColumn("step", month - F.lag(month).over(w)).where("gap is not null")
    out = gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").cast("long").alias("max_gap"), F.min(F.col("step") == 1).alias("monthly"))
    kind = F.when(F.col("monthly"), "monthly").when((F.col("median_gap") <= 4) & (F.col("max_gap") <= 14), "daily").otherwise("irregular")
    return out.select(*keys, "median_gap", "max_gap", kind.alias("frequency"))


def coverage(dates: DataFrame) -> DataFrame:
    """(year, n, first, last, covered): at least 200 rows from January 10 or before to December 20 or after."""
    years = dates.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    ok = (F.col("n") >= 200) & (F.dayofyear("first") <= 10) & ((F.month("last") == 12) & (F.dayofmonth("last") >= 20))
    return years.withColumn("covered", ok)


def split_by_position(returns: DataFrame, fraction: float) -> DataFrame:
    """``returns`` with part train or test: the first ``int(n * fraction)`` dates train. Dates are numbered apart from the rows, so no row sort is global."""
    dates = returns.select("date").distinct()
    n = dates.count()
    cut = int(n * fraction)
    if cut < 30 or n - cut < 10:
        raise InputError("training needs 30 dates and testing 10")
    last = dates.orderBy("date").limit(cut).agg(F.max("date").alias("last_train"))
    return returns.join(F.broadcast(last)).withColumn("part", F.when(F.col("date") <= F.col("last_train"), "train").otherwise("test")).drop("last_train")


def aligned(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The join of two tables on date (and ``keys``) whose dates are the same set; a date that a side lacks raises, nothing is intersected or filled."""
    on = [*keys, "date"]
    sides = left.select(*on).distinct().withColumn("l", F.lit(1)).join(right.select(*on).distinct().withColumn("r", F.lit(1)), on, "full")
    if not sides.where("l IS NULL OR r IS NULL").isEmpty():
        raise InputError("both tables must have the same dates")
    return left.join(right, on)


def complete_months(dates: DataFrame) -> DataFrame:
    """(year, n, covered): monthly dates cover a year with exactly twelve rows from January to December."""
    years = dates.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    return years.select("year", "n", ((F.col("n") == 12) & (F.month("a") == 1) & (F.month("b") == 12)).alias("covered"))


def exact_sum(value: Column, digits: int = 12) -> Column:
    """A sum that doesn't depend on the order of rows: in decimals, as a double."""
    return F.sum(value.cast(f"decimal(38,{digits})")).cast("double")


def unique_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` if no key is missing or repeated."""
    if not rows.groupBy(*keys).count().where(" OR ".join(["count > 1", *(f"`{k}` IS NULL" for k in keys)])).isEmpty():
        raise InputError(f"{keys} must name a row")
    return rows
