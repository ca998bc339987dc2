"""Exact order statistics, tails and ranks of groups of any size, without sorting a group in one task.

:func:`order_statistics` narrows the values between which the k-th smallest lies, a histogram at a time: each round counts the values of every group in ``BINS`` equal parts of
what is left, added up before anything is shuffled, and goes on in the part that holds the rank, until that part has one value. :func:`average_ranks` counts equal values first and
carries counts over ranges of values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .returns import InputError
from .scan import beside
from .stage import written

#: Parts of a round, and rounds after which something is wrong: each divides what is left by ``BINS``, of at most 2,100 powers of two.
BINS, ROUNDS = 1 << 16, 200


def order_statistics(rows: DataFrame, value: str, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """A row for each key: n, the values that it has, and by name those of ``ranks``, expressions of n, from 1 for the smallest; null where there is no such rank. Values must be
    finite; null ones are not counted. ``rows`` are read once a round, so they should be cheap to read; groups and ranks are few beside them."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("__name"), k.cast("long").alias("k")) for name, k in ranks.items())))
    # what is left of each rank: values from low to high, of which it is the __k-th
    todo = ends.select(*keys, "n", "__low", "__high", each.alias("__r")).select(*keys, "n", "__r.__name", F.when(F.col("__r.k").between(1, F.col("n")), F.col("__r.k")).alias("__k"), "__low", "__high")
    is_open = F.col("__k").isNotNull() & (F.col("__low") < F.col("__high"))
    done = []
    for _ in range(ROUNDS):
        seen = Observation()
        todo = written(todo.observe(seen, F.count_if(is_open).alias("n")), "ranks")
        done.append(todo.where(~is_open).select(*keys, "n", "__name", F.when(F.col("__k").isNotNull(), F.col("__low")).alias("__value")))
        if not seen.get["n"]:
            break
        left = todo.where(is_open)
        span = [*keys, "__low", "__high"]
        width = F.col("__high") / BINS - F.col("__low") / BINS
        part = F.coalesce(F.least(F.floor((F.col("__x") - F.col("__low")) / width), F.lit(BINS - 1)), F.lit(0))
        inside = beside(rows, left.select(*span).distinct(), *keys).where("__x between __low and __high")
        hist = inside.groupBy(*span, part.alias("__p")).agg(F.count("*").alias("__m"), F.min("__x").alias("__a"), F.max("__x").alias("__b"))
        hist = hist.withColumn("__upto", F.sum("__m").over(Window.partitionBy(*span).orderBy("__p")))
        found = beside(left, hist, *span).where("__k > __upto - __m AND __k <= __upto")
        todo = found.select(*keys, "n", "__name", (F.col("__k") - F.col("__upto") + F.col("__m")).alias("__k"), F.col("__a").alias("__low"), F.col("__b").alias("__high"))
    else:
        raise InputError("order statistics need finite values")
    every = reduce(DataFrame.unionByName, done)
    return every.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("__name") == name, F.col("__value"))).alias(name) for name in ranks))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """A row for each key with n and, by name, the quantiles of ``shares``: between the two nearest order statistics, in proportion, as ``percentile`` gives them."""
    at = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in shares.items()}
    found = order_statistics(rows, value, {f"{name}_{side}": f(x) + 1 for name, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}, *keys)
    between = lambda name, x: F.col(f"{name}_low") + (x - F.floor(x)) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return found.select(*keys, "n", *(between(name, x).alias(name) for name, x in at.items()))


def counted_up(counts: DataFrame, value: str, n: str, name: str, *keys: str) -> DataFrame:
    """``counts``, a row for each different value of ``keys``, with ``name``: the sum of ``n`` up to and with the value. Values are cut into ranges that may cut a group; what earlier ranges
    come to is carried over. Rows are sorted in ranges, so a group of any size is not sorted in one task, and no value is put beside another."""
    ranged = counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    own = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*keys, "__part").agg(F.sum(n).alias("__t")).select(*keys, "__part", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__c"))
    placed = beside(ranged.withColumn("__upto", F.sum(n).over(own)), carried, *keys, "__part")
    return placed.select(*(f"`{c}`" for c in counts.columns), (F.col("__c") + F.col("__upto")).alias(name))


def average_ranks(rows: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """``rows`` with ``name``, their rank by ``value`` from 1 within ``keys``; equal values share their mean rank, null ones have none. Equal values are counted first, so what is put in
    order is one row for each different value, by :func:`counted_up`. The join back deals rows by value, and Spark splits a value that very many rows have."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    placed = counted_up(counts, "__v", "__n", "__all", *keys)
    rank = (F.col("__all") - (F.col("__n") - 1) / 2).alias(name)
    ranks = placed.select(*(F.col(k).alias(f"__on_{k}") for k in keys), "__v", rank)
    on: Column = F.col(value) == F.col("__v")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return rows.join(ranks, on, "left").select(*(f"`{c}`" for c in rows.columns), name)
