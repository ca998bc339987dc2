"""Queries of the evidence predicates, over orders taken as disclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as e
from . import views as v
from .registry import add, r

AS_OF = "2000-01-01"


def _plus(text: Column, days: Column) -> Column:
    return F.date_format(F.date_add(text, days.cast("int")), "yyyy-MM-dd")


def disclosures(s: SparkSession, d: str) -> DataFrame:
    """Orders as disclosures, with text dates that miss, precede each other or carry an offset by turns of the key."""
    o, k = v.table(s, d, "orders"), F.col("id")
    day = F.to_date("o_orderdate")
    base = o.select(F.col("o_orderkey").alias("id"), day.alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"))
    base = base.withColumn("p", F.when(k % 11 == 0, F.date_add("day", -1)).otherwise(F.date_add("day", (k % 5).cast("int"))))
    base = base.withColumn("a", F.when(k % 5 != 0, F.date_add("p", (k % 4).cast("int"))))
    return base.select(
        "id",
        "day",
        "status",
        "value",
        "priority",
        F.date_format("day", "yyyy-MM-dd").alias("report_date"),
        F.concat(F.date_format("p", "yyyy-MM-dd"), F.when(k % 2 == 1, "T20:30:00Z").otherwise("")).alias("published_at"),
        F.when(k % 3 != 0, _plus(F.col("p"), k % 7)).alias("retrieved_at"),
        F.date_format(F.date_add("a", 1), "yyyy-MM-dd").alias("available_at"),
        F.when(k % 6 != 0, _plus(F.coalesce("a", "p"), k % 3)).alias("frozen_at"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("v"), k % 3)).alias("version_id"),
        F.when(k % 17 == 0, "short").otherwise(F.concat(F.md5(k.cast("string")), F.md5(k.cast("string")))).alias("source_sha256"),
    )


#: The same records, with the days that the texts stand for.
DISCLOSED = """base AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderstatus AS status, o_totalprice AS value, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate::DATE - 1 ELSE o_orderdate::DATE + (o_orderkey % 5)::INT END AS p FROM orders),
dated AS (SELECT *, CASE WHEN id % 5 <> 0 THEN p + (id % 4)::INT END AS a FROM base),
dis AS (SELECT *, p + (id % 2)::INT AS published, CASE WHEN id % 3 <> 0 THEN p + (id % 7)::INT END AS retrieved, a + 1 AS avail,
    CASE WHEN id % 6 <> 0 THEN coalesce(a, p) + (id % 3)::INT END AS frozen FROM dated)"""
REASON = """CASE WHEN day > published OR published > DATE '2000-01-01' THEN 'published_after_cutoff' WHEN retrieved < published THEN 'retrieved_before_publication' WHEN avail < published OR avail > DATE '2000-01-01' THEN 'not_available_by_cutoff'
WHEN frozen IS NOT NULL AND coalesce(frozen < avail, true) THEN 'frozen_before_available' WHEN id % 13 = 0 THEN 'no_version' WHEN id % 17 = 0 THEN 'no_hash'"""

FIELDS = ("report_date", "published_at", "retrieved_at", "available_at", "frozen_at", "version_id", "source_sha256")


def _row() -> dict[str, Column]:
    return {k: F.col(k) for k in FIELDS}


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


add("knowledge_day", f"WITH {DISCLOSED} SELECT id, published AS day FROM dis", lambda s, d: disclosures(s, d).select("id", e.knowledge_day("published_at").alias("day")))
add("epoch_day", "SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE AS day FROM events", lambda s,
    d: v.table(s, d, "events").select("event_id", e.epoch_day(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day")))
add("disclosure_timing", f"WITH {DISCLOSED} SELECT id, {REASON} END AS reason FROM dis", lambda s, d: disclosures(s, d).select("id", e.disclosure_reason(_row(), _day(AS_OF)).alias("reason")))
add(
    "disclosure_historical",
    f"WITH {DISCLOSED} SELECT id, {REASON} WHEN avail IS NULL OR frozen IS NULL OR frozen > DATE '2000-01-01' THEN 'not_frozen_by_cutoff' END AS reason FROM dis",
    lambda s, d: disclosures(s, d).select("id", e.disclosure_reason(_row(), _day(AS_OF), historical=True).alias("reason")),
)
add("effective_cutoff", f"WITH {DISCLOSED} SELECT id, least(published, avail, frozen) AS cutoff FROM dis", lambda s,
    d: disclosures(s, d).select("id", e.effective_cutoff(e.knowledge_day("published_at"), e.knowledge_day("available_at"), e.knowledge_day("frozen_at")).alias("cutoff")))


def acquired(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    stamp = F.concat(F.date_format(F.date_add("day", (k % 9 - 1).cast("int")), "yyyy-MM-dd"),
        F.when(k % 4 == 0, "T23:00:00").otherwise(F.when(k % 4 == 1, "T10:00:00+08:00").otherwise("T03:00:00-05:00")))
    return disclosures(s, d).select("id", "day", F.when(k % 10 == 0, "http://x.example").otherwise("https://x.example/a").alias("source"),
        F.when(k % 12 == 0, " ").otherwise("p. 4").alias("locator"), F.lit("1").alias("version"), F.col("report_date").alias("published"), stamp.alias("acquired_at"),
            F.col("source_sha256").alias("sha256"), (F.col("value") / 1000).alias("value"), "status")


#: The instant in UTC, null where no offset is stated.
ACQUIRED = f"""{DISCLOSED}, acq AS (SELECT *,
    CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN (day + (id % 9 - 1)::INT)::TIMESTAMP + INTERVAL 2 HOUR ELSE (day + (id % 9 - 1)::INT)::TIMESTAMP + INTERVAL 8 HOUR END AS at_utc
    FROM dis)"""


def _evidence(s: SparkSession, d: str) -> DataFrame:
    rows = acquired(s, d)
    reason, known = e.evidence_known({c: F.col(c) for c in ("source", "locator", "version", "published", "acquired_at", "sha256")}, F.lit("1999-06-01 00:00:00").cast("timestamp"))
    return rows.select("id", reason.alias("reason"), F.coalesce(known, F.lit(False)).alias("known"))


EVIDENCE = "CASE WHEN id % 10 = 0 THEN 'no_https' WHEN id % 12 = 0 THEN 'no_locator' WHEN at_utc IS NULL THEN 'no_dates' WHEN day > (at_utc + INTERVAL 8 HOUR)::DATE THEN 'acquired_before_publication' WHEN id % 17 = 0 THEN 'no_hash' END"
add("evidence_known", f"""WITH {ACQUIRED}, x AS (SELECT id, {EVIDENCE} AS reason, at_utc, day FROM acq) SELECT id, reason, coalesce(reason IS NULL AND at_utc <= TIMESTAMP '1999-06-01'
    AND day <= DATE '1999-06-01', false) AS known FROM x""", _evidence)
add(
    "evidence_available",
    f"""WITH {ACQUIRED} SELECT id,
    CASE WHEN at_utc IS NULL THEN 'no_instant' WHEN at_utc > TIMESTAMP '1999-06-01' THEN 'after_cutoff' WHEN at_utc > day::TIMESTAMP + INTERVAL 48 HOUR THEN 'after_signal' END AS reason FROM acq""",
    lambda s, d: acquired(s, d).select("id", e.available("acquired_at", "source", F.lit("1999-06-01 00:00:00").cast("timestamp"),
        F.col("day").cast("timestamp") + F.expr("INTERVAL 48 HOURS")).alias("reason")),
)


def _valued(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    rows = acquired(s, d).withColumns(
        {
            "basis": F.when(k % 5 == 0, "assumption").when(k % 23 == 0, "guess").otherwise("source-statement"),
            "note": F.when(k % 29 == 0, "").otherwise("stated"),
            "source_url": F.concat(F.col("source"), F.when(k % 31 == 0, ":8443/x").when(k % 37 == 0, "/a b").otherwise("")),
        }
    )
    rows = rows.withColumn("source_url", F.when(k % 31 == 0, "https://x.example:8443/x").when(k % 41 == 0, "https://u:p@x.example/").otherwise(F.col("source_url")))
    return rows.select("id", e.evidence_value({c: F.col(c) for c in ("value", "basis", "note", "source_url", "locator", "published")}, _day(AS_OF)).alias("reason"))


add(
    "evidence_value",
    f"""WITH {DISCLOSED} SELECT id, CASE WHEN id % 5 <> 0 AND id % 23 = 0 THEN 'no_basis' WHEN id % 29 = 0 THEN 'no_note' WHEN id % 5 <> 0
    AND (id % 31 = 0 OR id % 41 = 0 OR id % 37 = 0 OR id % 10 = 0 OR id % 12 = 0) THEN 'no_source'
    WHEN id % 5 <> 0 AND day > DATE '2000-01-01' THEN 'published_after_cutoff' END AS reason FROM dis""",
    _valued,
)
add(
    "execution_status",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'declared_only' END AS status
    FROM orders""",
    lambda s, d: v.table(s, d, "orders").select(F.col("o_orderkey").alias("id"),
        e.execution_status(F.array(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderkey") % 3 != 0, F.lit(True)), F.col("o_orderkey") % 7 != 0)).alias("status")),
)


def _bound(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("o_totalprice").alias("v/1~x"))).alias("rows")).alias("a")))
    value = F.when(k % 4 == 0, F.col("o_totalprice") * 1000 + 1).otherwise(F.col("o_totalprice") * 1000)
    pointer = F.when(k % 9 == 0, "/a/rows/1/v").otherwise("/a/rows/0/v~11~0x")
    told = F.date_format("o_orderdate", "yyyy-MM-dd")
    return v.table(s, d, "orders").select(k.alias("id"), e.binding_reason(doc, pointer, value, F.lit(1000.0), _day(AS_OF), told).alias("reason"))


add("pointer_binding", """SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 9 = 0 THEN 'no_field' WHEN o_orderkey % 4 = 0 THEN 'other_value' WHEN o_orderdate::DATE > DATE '2000-01-01' THEN 'published_after_cutoff' END AS reason
    FROM orders""", _bound)
add(
    "decimal_text",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE regexp_replace(regexp_replace(round(p_retailprice,
    2)::DECIMAL(38,12)::VARCHAR, '0+$', ''), '[.]$', '') END AS text FROM part""",
    lambda s, d: v.table(s, d, "part").select(F.col("p_partkey").alias("id"),
        e.decimal_text(F.when(F.col("p_partkey") % 8 == 0, "n/a").otherwise(F.round("p_retailprice", 2).cast("decimal(20,2)").cast("string"))).alias("text")),
)
add(
    "source_urls",
    r"SELECT page_id, regexp_matches(url, '^https://[^/?#@:\s]+(/|\?|#|$)') AND NOT regexp_matches(url, '\s') AS secure, regexp_matches(url, '^https?://[^/?#@:\s]+(/|\?|#|$)') AND NOT regexp_matches(url, '\s') AS plain FROM pages",
    lambda s, d: v.table(s, d, "pages").select("page_id", e.url_ok("url").alias("secure"), e.url_ok("url", https_only=False).alias("plain")),
)
add(
    "number_guards",
    """SELECT c_custkey AS id, c_acctbal >= 0 AND c_acctbal <= 9000 AS in_range, length(trim(c_mktsegment)) > 0 AS named,
    regexp_matches(lpad(c_custkey::VARCHAR, 6, '0'), '^[0-9]{6}$') AS is_code, regexp_matches(c_name, '^[A-Za-z0-9_-]{1,64}$') AS portable FROM customer""",
    lambda s, d: v.table(s, d, "customer").select(F.col("c_custkey").alias("id"), e.finite("c_acctbal", 0, 9000).alias("in_range"), e.has_text("c_mktsegment").alias("named"),
        e.is_code(F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("is_code"), e.is_portable_id("c_name").alias("portable")),
)
add(
    "unit_fields",
    f"""SELECT l_returnflag AS flag, count(CASE WHEN l_linestatus = 'O' THEN 1 END)::BIGINT AS n, {r('sum(CASE WHEN l_linestatus = chr(79) THEN l_quantity END) AS total')}
    FROM lineitem GROUP BY 1""",
    lambda s, d: v.table(s, d, "lineitem").withColumn("q",
        e.with_unit(F.col("l_quantity").cast("string"), "l_linestatus", "O")).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("q").alias("n"), F.sum("q").alias("total")),
)


def _compared(s: SparkSession, d: str) -> DataFrame:
    n = v.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("m"), F.max("c_acctbal").alias("x"))
    base = n.where("nation = 0").select(F.col("m").alias("bm"), F.col("x").alias("bx"))
    label = e.tradeoff(F.col("m") - F.col("bm"), F.col("bx") - F.col("x"), F.col("nation") == 0)
    return n.join(F.broadcast(base)).select("nation", label.alias("label"))


add(
    "tradeoff_labels",
    """WITH n AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS m, max(c_acctbal) AS x FROM customer GROUP BY 1), d AS (SELECT n.nation, n.m - b.m AS g, b.x - n.x AS w
    FROM n, (SELECT m, x FROM n WHERE nation = 0) b)
    SELECT nation::BIGINT AS nation, CASE WHEN nation = 0 THEN 'baseline' WHEN g > 1e-8 AND w > 1e-8 THEN 'better_both' WHEN g < -1e-8
    AND w > 1e-8 THEN 'less_drawdown_less_return' WHEN g > 1e-8 AND w < -1e-8 THEN 'more_return_more_drawdown' WHEN g < -1e-8
    AND w < -1e-8 THEN 'worse_both' ELSE 'mixed' END AS label FROM d""",
    _compared,
)
RETURNS = """daily AS (SELECT l_returnflag AS asset, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY ALL)"""
add("trailing_window", f"""WITH {RETURNS} SELECT asset, date, {r('v')} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM daily) WHERE k <= 250""", lambda s,
    d: e.trailing(v.daily(s, d), 250, "asset"))
add(
    "thinned_path",
    f"""WITH {RETURNS}, k AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM daily
    WINDOW w AS (PARTITION BY asset ORDER BY date)), g AS (SELECT DISTINCT asset, floor(j * (n - 1) / 499.0 + 1e-9) AS k FROM (SELECT DISTINCT asset, n FROM k), range(500) t(j))
    SELECT asset, date, {r('v')} FROM k WHERE n <= 500 OR (asset, k) IN (SELECT asset, k FROM g)""",
    lambda s, d: e.thinned(v.daily(s, d), 500, "asset"),
)
add(
    "percent_text",
    "SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, printf('%.2f%%', l_discount * 100) AS text FROM lineitem",
    lambda s, d: v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), e.percent_text("l_discount").alias("text")),
)
add(
    "set_difference",
    """WITH o AS (SELECT o_custkey AS id FROM orders), c AS (SELECT c_custkey AS id FROM customer) SELECT id, 'left' AS side FROM (SELECT DISTINCT id FROM o EXCEPT SELECT id FROM c)
    UNION ALL SELECT id, 'right' FROM (SELECT id FROM c EXCEPT SELECT id FROM o)""",
    lambda s, d: e.same_sets(v.table(s, d, "orders").select(F.col("o_custkey").alias("id")).distinct(), v.table(s, d, "customer").select(F.col("c_custkey").alias("id")).distinct()),
)
add(
    "one_to_one",
    f"SELECT l_orderkey AS id, {r('sum(l_quantity) AS q', 'max(o_totalprice) AS p')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    lambda s, d: e.bijection(v.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("q")),
        v.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p")).join(v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id",
            "left_semi"), "id"),
)
