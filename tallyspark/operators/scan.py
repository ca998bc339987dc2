"""Running sums, products and highs of long series, in blocks.

A window over a whole series sorts it in one task. Here a series is cut into blocks of its order (months of dates, days of instants, ranges of whole numbers); each block is
sorted by itself, its totals are one row, and what earlier blocks come to is carried over those rows and joined back. So the length of one series doesn't bound anything but the
number of its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whole numbers in a block.
WIDE = 1024


def block_of(rows: DataFrame, order: str) -> Column:
    """The block of a row; it never falls as ``order`` grows."""
    kind = dict(rows.dtypes)[order]
    if kind == "date":
        return F.trunc(order, "MM")
    if kind.startswith("timestamp"):
        return F.date_trunc("day", order)
    return F.floor(F.col(order) / WIDE)


def beside(rows: DataFrame, carried: DataFrame, *on: str) -> DataFrame:
    """Both tables side by side where ``on`` is the same, nulls too; without ``on`` each row beside each."""
    if not on:
        return rows.crossJoin(carried)
    named = carried.select(*(F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in carried.columns))
    return rows.join(named, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on)))


def running(rows: DataFrame, *keys: str, order: str = "date", sums: dict[str, Column] | None = None, products: dict[str, Column] | None = None, block: Column | None = None) -> DataFrame:
    """``rows`` with the running sums and products of expressions within ``keys``, up to and with each row. ``order`` must be unique within a key; null terms are left out."""
    sums, products = sums or {}, products or {}
    terms = {**{n: (F.sum, e, 0.0) for n, e in sums.items()}, **{n: (F.product, e, 1.0) for n, e in products.items()}}
    cut = rows.withColumn("__block", block_of(rows, order) if block is None else block)
    on = (*keys, "__block")
    own = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*on).agg(*(f(e).alias(f"__t_{n}") for n, (f, e, _) in terms.items()))
    carried = totals.select(*on, *(F.coalesce(f(f"__t_{n}").over(before), F.lit(z)).alias(f"__c_{n}") for n, (f, _, z) in terms.items()))
    local = cut.withColumns({f"__l_{n}": F.coalesce(f(e).over(own), F.lit(z)) for n, (f, e, z) in terms.items()})
    whole = {n: F.col(f"__c_{n}") + F.col(f"__l_{n}") if n in sums else F.col(f"__c_{n}") * F.col(f"__l_{n}") for n in terms}
    return beside(local, carried, *on).select(*(f"`{c}`" for c in rows.columns if c not in whole), *(e.alias(n) for n, e in whole.items()))


def growth_and_high(rows: DataFrame, growth: Column, *keys: str, order: str = "date", block: Column | None = None) -> DataFrame:
    """``rows`` with nav, the running product of ``growth``, which must not be negative, and high, the greatest nav so far."""
    cut = rows.withColumn("__block", block_of(rows, order) if block is None else block).withColumn("__g", growth)
    on = (*keys, "__block")
    own = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__l", F.product("__g").over(own))
    totals = local.groupBy(*on).agg(F.product("__g").alias("__p"), F.max("__l").alias("__top"))
    carried = totals.withColumn("__c", F.coalesce(F.product("__p").over(before), F.lit(1.0))).withColumn("__h", F.max(F.col("__c") * F.col("__top")).over(before))
    inside = local.withColumn("__m", F.max("__l").over(own))
    nav, high = F.col("__c") * F.col("__l"), F.greatest("__h", F.col("__c") * F.col("__m"))
    return beside(inside, carried.select(*on, "__c", "__h"), *on).select(*(f"`{c}`" for c in rows.columns if c not in ("nav", "high")), nav.alias("nav"), high.alias("high"))
