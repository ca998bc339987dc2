import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evidence as e
from tallyspark.operators.returns import InputError
from tallyspark.sources import nav, observations


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_days(spark):
    got = one(spark, *(e.knowledge_day(F.lit(x)) for x in ("2024-02-29", "2023-02-29", "2024-01-01T16:00:00Z", "2024-01-01T15:59:59+00:00", "2024-01-01T20:00:00", "20240101")))
    assert got == (dt.date(2024, 2, 29), None, dt.date(2024, 1, 2), dt.date(2024, 1, 1), None, None)
    assert one(spark, e.epoch_day(F.lit(0)), e.epoch_day(F.lit(57_600_000)), e.epoch_day(F.lit(-1))) == (dt.date(1970, 1, 1), dt.date(1970, 1, 2), None)


def test_days_do_not_depend_on_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, e.knowledge_day(F.lit("2024-01-01T16:00:00Z"))) == (dt.date(2024, 1, 2),)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_text(spark):
    assert one(spark, *(e.decimal_text(F.lit(x)) for x in ("1.500", "100", "0.0", "-1", "x", "100.0"))) == ("1.5", "100", None, None, None, "100")
    assert one(spark, *(e.url_ok(F.lit(x)) for x in ("https://a.b/c", "http://a.b", "https://u:p@a.b/", "https://a.b:8443/", "https://a.b:443/x", "https://a b/", "no"))) == (True, False,
        False, False, True, False, False)


def test_pointers(spark):
    doc = F.lit(json.dumps({"a/b": [{"x~y": 2.5, "m": {"n": 3}}]}))
    got = one(spark, *(e.binding_reason(doc, F.lit(p), F.lit(v), F.lit(s), F.lit(None).cast("date")) for p, v,
        s in (("/a~1b/0/x~0y", 2500.0, 1000.0), ("/a~1b/0/m/n", 3.0, 1.0), ("/a~1b/1/m", 3.0, 1.0), ("/a~1b/0/m/n", 3.1, 1.0), ("a", 1.0, 1.0), ("/a~1b/0/m/n", 3.0, 0.0))))
    assert got == (None, None, "no_field", "other_value", "no_pointer", "no_scale")


def test_unknown_fields_and_sets(spark):
    with pytest.raises(InputError):
        e.unknown_fields({"a": 1, "b": 2}, {"a"})
    left, right = (spark.createDataFrame([(k, k) for k in ks], "id int, v int") for ks in ((1, 2), (2, 3)))
    assert sorted(tuple(r) for r in e.same_sets(left, right).collect()) == [(1, 1, "left"), (3, 3, "right")]
    with pytest.raises(InputError):
        e.bijection(left, right.withColumnRenamed("v", "w"), "id")
    assert e.bijection(left, left.withColumnRenamed("v", "w"), "id").count() == 2


def test_thinned_keeps_both_ends(spark):
    df = spark.range(1234).select(F.lit("a").alias("k"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("date"), "id")
    got = sorted(r["id"] for r in e.thinned(df, 100, "k").collect())
    assert len(got) == 100 and got[0] == 0 and got[-1] == 1233 and max(b - a for a, b in zip(got, got[1:])) <= 13


REQ = {"id": "r1", "source": nav.SOURCE, "fundCode": "000001", "start": "2024-01-05", "end": "2024-02-10", "asOf": "2024-03-01", "currency": "CNY", "frequency": "daily", "fields": nav.COLUMNS}


def test_nav_records(spark):
    raw = nav.teaching_response()
    got = nav.parsed(raw, REQ, origin="teaching")
    assert got["coverage"] == {"start": "2024-01-05", "end": "2024-02-10", "count": 37, "completeness": "unknown"} and nav.validate(got) is got
    assert nav.replayed(got, raw)["data"] == got["data"]
    for change in ({"fundCode": 1}, {"start": "2024-03-05"}, {"currency": "USD"}, {"more": 1}):
        with pytest.raises(InputError):
            nav.request(REQ | change)
    for bad in (raw.replace(b'"000001"', b'"000002"'), raw.replace(b"fS_code", b"other")):
        with pytest.raises(InputError):
            nav.parsed(bad, REQ)
    with pytest.raises(InputError):
        nav.replayed(got, raw + b" ")
    with pytest.raises(InputError):
        nav.validate(got | {"name": "other"})
    with pytest.raises(InputError):
        nav.fetched(REQ)
    failed = nav.fetched(REQ, True, lambda url: (_ for _ in ()).throw(OSError("gone")))
    assert failed["status"] == "failed" and failed["failure"] == "gone" and nav.validate(failed)
    rows = [{"date": "2024-01-06", "nav": "1.10"}, {"date": "2024-01-05", "nav": "1"}]
    with pytest.raises(InputError):
        nav.normalized(rows, REQ)
    assert [r["unit_nav"] for r in nav.normalized(rows[::-1], REQ)] == ["1", "1.1"]


def test_native_archives():
    bundle = {"type": "research-bundle", "asOf": "2024-03-01", "rows": [{"kind": "fund", "code": "000001", "historyBasis": "nav-with-distributions", "history": [{"date": "2024-01-05", "nav": 1.5}]}]}
    assert nav.from_native(bundle, REQ)["data"] == [{"date": "2024-01-05", "unit_nav": "1.5", "distribution_text": ""}]
    for bad in (bundle | {"asOf": "2024-03-02"}, bundle | {"rows": []}, {"type": "other"}):
        with pytest.raises(InputError):
            nav.from_native(bad, REQ)


def test_nav_source(spark):
    spark.dataSource.register(nav.NavSource)
    got = spark.read.format("fund_nav").option("requests", json.dumps([REQ, REQ | {"id": "r2", "fundCode": "000002"}])).option("teaching", "true").load()
    assert got.groupBy("id").count().where("count = 37").count() == 2 and got.where("status = 'failed'").count() == 0
    table = nav.records_table(spark, [nav.parsed(nav.teaching_response(), REQ)])
    assert nav.dated_rows(table, "nav", "id").count() == 37
    with pytest.raises(InputError):
        nav.dated_rows(table.union(table.limit(1)), "nav", "id")


def observation(**change):
    row = {"id": "1", "entity": "e", "metric": "m", "value": "1.50", "unit": "u", "currency": None, "basis": "b", "periodStart": "2024-01-01", "periodEnd": "2024-02-01", "observedAt": None,
        "publishedAt": "2024-02-02T00:00:00Z", "availableAt": "2024-02-03T00:00:00+08:00", "retrievedAt": "2024-02-05T00:00:00Z", "sourceUrl": "https://x.example", "sourceVersion": "1",
            "locator": "p", "verification": observations.DECLARED}
    return row | change


def table(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in observations.FIELDS) for r in rows], ", ".join(f"{f} string" for f in observations.FIELDS))


def test_observations(spark):
    cutoff = F.lit("2024-02-10 00:00:00").cast("timestamp")
    rows = [observation(), observation(id="2", availableAt=None, publishedAt=None), observation(id="3", retrievedAt="2024-03-01T00:00:00Z")]
    late, unknown = observations.validated(table(spark, rows), cutoff)
    assert [r["id"] for r in late.collect()] == ["3"] and [r["id"] for r in unknown.collect()] == ["2"]
    for change in ({"value": "x"}, {"currency": "EUR"}, {"periodEnd": "2023-01-01"}, {"retrievedAt": None}, {"retrievedAt": "2024-02-05"}, {"sourceUrl": "http://x"}, {"unit": " "},
        {"availableAt": "2024-01-01T00:00:00Z"}):
        with pytest.raises(InputError):
            observations.validated(table(spark, [observation(**change)]), cutoff)
    with pytest.raises(InputError):
        observations.validated(table(spark, [observation(), observation()]), cutoff)


def test_observations_are_made_and_judged_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = table(spark, [observation(id=str(k), availableAt=None if k % 2 else "2024-02-03T00:00:00Z") for k in range(20)])
    late, unknown = observations.validated(rows.mapInArrow(counted, rows.schema), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    assert late.count() == 20 and unknown.count() == 10 and made.value == 20


def test_columns_and_constants(spark):
    from tallyspark.sources import mapped_columns

    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    got = mapped_columns(rows, {"id": "a", "name": "b"}, {"unit": "base", "currency": None}, ["id", "name", "unit", "currency"])
    assert got.first().asDict() == {"id": "1", "name": "x", "unit": "base", "currency": None}
    for columns, constants in (({"id": "a"}, {"name": "n", "unit": "u"}), ({"id": "a", "name": "b"}, {"name": "n", "unit": "u", "currency": None})):
        with pytest.raises(InputError):
            mapped_columns(rows, columns, constants, ["id", "name", "unit", "currency"])
