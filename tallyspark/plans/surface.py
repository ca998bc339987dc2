"""Queries in SQL text over registered functions, and streams over the table of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions, streaming
from ..operators import factors
from ..operators.stage import folder
from . import views as v
from .catalog import GRAPH, RET
from .registry import SQL, add, r


def text(sql: str, **tables) -> callable:
    """A query in SQL text over registered functions; ``tables`` make its inputs."""

    def run(s: SparkSession, d: str) -> DataFrame:
        functions.register(s)
        return s.sql(sql, **{n: f(s, d) for n, f in tables.items()})

    return run


add("sql_xirr", SQL["xirr"], text("SELECT owner, round(xirr(date, amount), 6) AS xirr FROM {flows} GROUP BY owner", flows=v.invested))
add(
    "sql_expected_shortfall",
    f"""WITH {RET}, t AS (SELECT asset, -r AS loss, (1 - 0.95) * count(*) OVER (PARTITION BY asset) - (row_number() OVER (PARTITION BY asset ORDER BY -r DESC) - 1) AS k FROM ret)
    SELECT asset, {r('sum(loss * greatest(0, least(1, k))) / sum(greatest(0, least(1, k))) AS es')} FROM t GROUP BY asset""",
    text("SELECT asset, expected_shortfall(r, 0.95D) AS es FROM {ret} GROUP BY asset", ret=v.ret),
)
add(
    "sql_lookthrough",
    f"""WITH {GRAPH.split(',\nwalk AS')[0]}, s1 AS (SELECT node, sum(weight) AS total FROM edges GROUP BY node),
    top AS (SELECT * FROM edges WHERE kind = 'fund' AND node <> 'world'),
    leaves AS (SELECT t.node AS root, e.child AS leaf, e.kind, NULL AS reason, t.weight * e.weight AS w FROM top t JOIN edges e ON e.node = t.child
        UNION ALL SELECT t.node, 'unknown', 'unknown', 'undisclosed', t.weight * (1 - s1.total) FROM top t JOIN s1 ON s1.node = t.child
        UNION ALL SELECT DISTINCT t.node, 'unknown', 'unknown', 'undisclosed', 1 - s1.total FROM top t JOIN s1 ON s1.node = t.node)
    SELECT root, leaf, kind, reason, count(*)::BIGINT AS n, {r('1000 * sum(w) AS w')} FROM leaves GROUP BY ALL""",
    text(
        """WITH edges AS (
            SELECT node AS root, * FROM {graph} WHERE kind = 'fund' AND node <> 'world'
            UNION ALL SELECT g.node, e.* FROM {graph} g JOIN {graph} e ON e.node = g.child WHERE g.kind = 'fund' AND g.node <> 'world')
        SELECT root, leaf, kind, reason, count(*) AS n, 1000 * sum(w) AS w FROM lookthrough(TABLE(SELECT * FROM edges) PARTITION BY (root), 5) GROUP BY ALL""",
        graph=v.graph,
    ),
)


# One cross-section of every line item: its rows are ranked in ranges of values.
add(
    "wide_cross_section",
    f"""WITH p AS (SELECT year(l_shipdate) // 100 AS century, l_discount AS factor, l_extendedprice / l_quantity AS fwd FROM lineitem),
    k AS (SELECT *, rank() OVER (PARTITION BY century ORDER BY factor) + (count(*) OVER (PARTITION BY century,
    factor) - 1) / 2.0 AS fr, rank() OVER (PARTITION BY century ORDER BY fwd) + (count(*) OVER (PARTITION BY century, fwd) - 1) / 2.0 AS yr,
        count(*) OVER (PARTITION BY century) AS n FROM p),
    b AS (SELECT *, least(5, floor((fr - 1) * 5 / n) + 1) AS bucket FROM k)
    SELECT century::BIGINT AS signal_date, count(*)::BIGINT AS n,
    {r('covar_pop(factor, fwd) / nullif(stddev_pop(factor) * stddev_pop(fwd), 0) AS ic', 'covar_pop(fr, yr) / nullif(stddev_pop(fr) * stddev_pop(yr), 0) AS rank_ic')},
        round((avg(fwd) FILTER (bucket = 5) - avg(fwd) FILTER (bucket = 1))::DOUBLE, 5) + 0.0 AS spread FROM b GROUP BY century""",
    lambda s, d: factors.information(lines(s, d), wide=True).withColumn("spread", F.round("spread", 5)),
)


def lines(s: SparkSession, d: str) -> DataFrame:
    century = F.floor(F.year("l_shipdate") / 100)
    return v.table(s, d, "lineitem").select(century.alias("signal_date"), F.col("l_orderkey").alias("security"), F.col("l_discount").alias("factor"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("fwd"))


def streamed(s: SparkSession, d: str, shape, work, time: str, name: str) -> DataFrame:
    """``work`` over a stream of the table of events in the form that ``shape`` gives, ended by a closing row. A stream follows folders and patterns; the table may be one file."""
    path, at = f"{d}/events.parquet", f"{folder(s)}/{name}-{uuid.uuid4().hex[:12]}"
    table = s.read.parquet(path)
    streaming.closing(shape(table), time).write.parquet(f"{at}/end")
    live = shape(s.readStream.schema(table.schema).parquet(f"{d}/event[s].parquet")).unionByName(s.readStream.schema(shape(table).schema).parquet(f"{at}/end"))
    return streaming.followed(s, work(live), f"{at}/told", f"{at}/checkpoint")


def events(table: DataFrame) -> DataFrame:
    return table.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("security"), "value")


def valued(table: DataFrame) -> DataFrame:
    """Events as valuations of their users' accounts, a tenth of the value paid in or out after each."""
    flow = F.when(F.col("event_id") % 2 == 0, 0.1).otherwise(-0.1) * F.col("value")
    return table.select(F.col("user_id").alias("account"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), (100 + F.col("value")).alias("before"), flow.alias("flow"))


add(
    "stream_bars",
    f"""SELECT event_type AS security, date_trunc('hour', ts) AS at,
    {r('arg_min(value, (ts, event_id)) AS open', 'max(value) AS high', 'min(value) AS low', 'arg_max(value, (ts, event_id)) AS close')}, count(*)::BIGINT AS volume
    FROM events GROUP BY ALL""",
    lambda s, d: streamed(s, d, events, streaming.bars, "ts", "bars"),
)
add(
    "stream_unit_nav",
    f"""WITH e AS (SELECT user_id AS account, ts AS at, event_id AS id, 100 + value AS before, CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE -0.1 END * value AS flow FROM events),
    g AS (SELECT *, coalesce(before / lag(before + flow) OVER (PARTITION BY account ORDER BY at, id), 1) AS g FROM e)
    SELECT account, at, id, {r('before', 'flow', 'exp(sum(ln(g)) OVER (PARTITION BY account ORDER BY at, id)) AS nav')} FROM g""",
    lambda s, d: streamed(s, d, valued, streaming.unit_nav, "at", "units"),
)
