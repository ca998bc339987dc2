"""Streams of files against the same figures of the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark import streaming

EVENT = "ts timestamp, event_id long, security string, value double"
VALUE = "account long, at timestamp, id long, before double, flow double"
START = dt.datetime(2024, 1, 1)


def batch_bars(rows):
    found = {}
    for ts, id_, security, value in sorted(rows):
        found.setdefault((security, ts.replace(minute=0, second=0, microsecond=0)), []).append(value)
    return {k: (v[0], max(v), min(v), v[-1], len(v)) for k, v in found.items()}


def test_bars_go_on_after_a_stop(spark, tmp_path):
    rng = random.Random(5)
    rows = [(START + dt.timedelta(minutes=rng.randint(0, 3000)), k, rng.choice("ab"), float(rng.randint(1, 99))) for k in range(400)]
    rows.sort()
    early, late = rows[:250], rows[250:]
    swapped = early[:200] + early[200:][::-1]  # out of order, within what is allowed
    end = streaming.closing(spark.createDataFrame(rows, EVENT), "ts")
    folder, target, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    run = lambda: streaming.followed(spark, streaming.bars(spark.readStream.schema(EVENT).parquet(folder)), target, at)
    spark.createDataFrame(swapped, EVENT).coalesce(1).write.parquet(folder)
    first = run().count()
    assert 0 < first < len(batch_bars(early))  # windows that may still change wait
    spark.createDataFrame(late, EVENT).coalesce(1).write.mode("append").parquet(folder)
    end.write.mode("append").parquet(folder)
    got = {(r["security"], r["at"]): tuple(r)[2:] for r in run().collect()}
    assert got == batch_bars(rows)
    assert run().count() == len(got)  # nothing new, nothing twice


def valuations(rng, accounts=6, n=120):
    return [(rng.randint(1, accounts), START + dt.timedelta(minutes=rng.randint(0, 2000), seconds=k), k, 100 + rng.random() * 20, rng.choice([0.0, 5.0, -5.0])) for k in range(n)]


def test_unit_nav_goes_on_after_a_stop(spark, tmp_path):
    rows = sorted(valuations(random.Random(6)), key=lambda r: r[1])
    parts = [rows[:40], rows[40:45] + rows[46:90], [rows[45]] + rows[90:]]
    parts[2], dropped = parts[2][1:], parts[2][0]
    folder, target, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    told = []
    for part in parts:
        spark.createDataFrame(part, VALUE).coalesce(1).write.mode("append").parquet(folder)
        told.append(streaming.followed(spark, streaming.unit_nav(spark.readStream.schema(VALUE).parquet(folder), "3 hours"), target, at).count())
    # a row that comes far behind the watermark is left out, and the closing row lets all others go
    spark.createDataFrame([dropped], VALUE).write.mode("append").parquet(folder)
    streaming.closing(spark.createDataFrame(rows, VALUE), "at").write.mode("append").parquet(folder)
    got = streaming.followed(spark, streaming.unit_nav(spark.readStream.schema(VALUE).parquet(folder), "3 hours"), target, at)
    want = streaming.unit_nav_batch(spark.createDataFrame([r for r in rows if r != dropped], VALUE))
    rows_of = lambda df: {(r["account"], r["id"]): (r["at"], r["before"], r["flow"], r["nav"]) for r in df.collect()}
    a, b = rows_of(got), rows_of(want)
    assert told == sorted(told) and told[0] < 40 and set(a) == set(b) and got.count() == len(a)
    for k, row in b.items():
        assert a[k][:3] == row[:3] and a[k][3] == pytest.approx(row[3])


def test_accounts_share_state_and_all_are_told(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k % 1500, START + dt.timedelta(minutes=rng.randint(0, 2000), seconds=k), k, 100 + rng.random() * 20, rng.choice([0.0, 5.0])) for k in range(4500)]
    batch = streaming.unit_nav_batch(spark.createDataFrame(rows, VALUE))
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, VALUE).write.parquet(folder)
    streaming.closing(spark.createDataFrame(rows, VALUE), "at").write.mode("append").parquet(folder)
    rounded = lambda df: df.withColumn("nav", F.round("nav", 9))
    for more in ({}, {"buckets": 1}):  # in one bucket all wait beside the closing row, which is never told
        out = str(tmp_path / f"out{len(more)}")
        got = streaming.followed(spark, streaming.unit_nav(spark.readStream.schema(VALUE).parquet(folder), **more), out, out + "-at")
        assert got.count() == len(rows) and rounded(got).exceptAll(rounded(batch)).count() == 0
        held = spark.read.format("statestore").option("path", out + "-at").option("stateVarName", "last").load().count()
        assert held <= more.get("buckets", 1024)  # not a state for each of 1,500 accounts


def test_closing_row_of_nothing(spark):
    assert streaming.closing(spark.createDataFrame([], EVENT), "ts").select(F.col("ts").isNull()).first()[0]
