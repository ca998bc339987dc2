"""Running figures from streams of files: an extension, with results equal to the batch operators once the watermark has passed.

- :func:`bars`: opening, highest, lowest and closing value and number of events of each event-time window.
- :func:`unit_nav`: the value of a unit of each account after each valuation, with state for each bucket of accounts.

Rows may come out of order by as much as ``late``; later ones are left out. :func:`followed` runs a stream over what files there are, appends to a table and keeps its place in a
checkpoint, so that a stopped or failed run goes on where it was, each row counted once. What lies within ``late`` of the latest event isn't told yet; :func:`closing` makes
the row that ends a stream that is known to be complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State that doesn't fit in an executor's memory is kept on its disk and in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAV = "account long, us long, id long, before double, flow double, nav double"
#: Groups of accounts that share a state: a call for each account and batch costs more than its rows do. Fixed for the life of a checkpoint.
BUCKETS = 1024
#: A waiting valuation (us: microseconds), and an account's value after its last flow with its unit's, as they are packed in the state.
WAITING = np.dtype([("account", "<i8"), ("us", "<i8"), ("id", "<i8"), ("before", "<f8"), ("flow", "<f8")])
LAST = np.dtype([("account", "<i8"), ("after", "<f8"), ("nav", "<f8")])


def bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(security, at, open, high, low, close, volume) of events (ts, event_id, security, value). Windows are told once, when nothing in them can come any more;
    first and last are by (ts, event_id), so the order of arrival doesn't matter."""
    order = F.struct("ts", "event_id")
    seen = events.withWatermark("ts", late).groupBy("security", F.window("ts", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    )
    return seen.select("security", F.col("w.start").alias("at"), "open", "high", "low", "close", "volume")


class UnitNav(StatefulProcessor):
    """Valuations of a bucket's accounts wait until the watermark has passed them, and are then taken in order of (account, at, id). State is each account's last value after a flow and
    its unit's value, in order of accounts, and what waits. A timer stands behind the first row that waits of each batch, and of what was left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for batch in rows:
            new = np.empty(len(batch), WAITING)
            for name in WAITING.names:
                new[name] = batch[name].to_numpy()
            self.waiting.appendValue((new.tobytes(),))
            first.append(int(new["us"].min()))
        if first:
            self.handle.registerTimer(min(first) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.frombuffer(b"".join(bytes(r[0]) for r in self.waiting.get()), WAITING)
        due, rest = rows[rows["us"] < until], rows[rows["us"] >= until]
        if not len(due):
            return
        last = np.frombuffer(bytes(self.last.get()[0]) if self.last.exists() else b"", LAST)
        due = due[np.lexsort([due[n] for n in ("flow", "before", "id", "us", "account")])]
        after = due["before"] + due["flow"]
        starts = np.flatnonzero(np.concatenate(([True], due["account"][1:] != due["account"][:-1])))
        grown = np.ones(len(due))
        grown[1:] = due["before"][1:] / after[:-1]
        grown[starts] = 1.0
        _, here, there = np.intersect1d(due["account"][starts], last["account"], assume_unique=True, return_indices=True)
        grown[starts[here]] = last["nav"][there] * due["before"][starts[here]] / last["after"][there]
        nav = pd.Series(grown).groupby(np.repeat(starts, np.diff(np.append(starts, len(due))))).cumprod().to_numpy()
        ends = np.append(starts[1:], len(due)) - 1
        told = np.empty(len(ends), LAST)
        told["account"], told["after"], told["nav"] = due["account"][ends], after[ends], nav[ends]
        told = np.concatenate((np.delete(last, there), told))
        self.last.update((told[np.argsort(told["account"])].tobytes(),))
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame({**{n: due[n] for n in WAITING.names}, "nav": nav})

    def close(self) -> None:
        pass


def unit_nav(valuations: DataFrame, late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """(account, at, id, before, flow, nav) of a stream of valuations (account, at, id, before, flow; none of them null): a unit is worth 1 at an account's first valuation and grows by what the account is
    worth before a flow over what it was worth after the last one. Accounts are dealt over ``buckets`` by hash; a task holds what waits in one of them."""
    bucket = F.pmod(F.xxhash64(F.col("account").cast("long")), F.lit(buckets)).alias("bucket")
    held = valuations.withWatermark("at", late).select(bucket, "at", F.unix_micros("at").alias("us"), *(F.col(n).cast("long").alias(n) for n in ("account", "id")),
        *(F.col(n).cast("double").alias(n) for n in ("before", "flow")))
    told = held.groupBy("bucket").transformWithStateInPandas(statefulProcessor=UnitNav(), outputStructType=NAV, outputMode="Append", timeMode="EventTime")
    return told.select("account", F.timestamp_micros("us").alias("at"), "id", "before", "flow", "nav")


def unit_nav_batch(valuations: DataFrame) -> DataFrame:
    """The same of a table, for what is there at once."""
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy("at", "id")
    grown = F.coalesce(F.col("before") / F.lag(F.col("before") + F.col("flow")).over(w), F.lit(1.0))
    return valuations.withColumn("g", grown).withColumn("nav", F.product("g").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("account", "at", "id", "before", "flow", "nav")


def followed(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run ``stream`` over all files that there are, append what it tells to the Parquet table ``target``, and give that table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def closing(rows: DataFrame, time: str, days: int = 2) -> DataFrame:
    """One row whose ``time`` is some days after the latest of ``rows``: once it has come, every earlier row is told. It is never told itself; its numbers are -1, its texts empty."""
    last = F.max(time) + F.expr(f"interval {days} days")
    return rows.agg(last.alias(time)).select(*(F.col(time) if n == time else F.lit("" if t == "string" else -1).cast(t).alias(n) for n, t in rows.dtypes))
