"""Queries of contributions, studies, scores, guards and path comparisons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candles, evidence, factors, ledgers, returns, risk
from . import views as v
from .catalog import BARS, PANEL, RET
from .registry import add, r

# Contributions: every month 100 into the path of A, with a distribution each quarter that is reinvested or kept, and a split in each July.
NAV = """nv AS (SELECT date, nav FROM path WHERE asset = 'A'), pl AS (SELECT m::DATE AS d FROM unnest(generate_series(TIMESTAMP '1995-02-01', TIMESTAMP '2001-06-01',
    INTERVAL 1 MONTH)) g(m)), b AS (SELECT used AS date, count(*) AS k FROM (SELECT (SELECT min(date) FROM nv WHERE date >= d) AS used FROM pl) WHERE used IS NOT NULL
    GROUP BY 1)"""


def plan_days(s: SparkSession, d: str) -> DataFrame:
    nav = risk.nav_path(v.ret(s, d).where("asset = 'A'"), "asset").select("date", "nav")
    planned = s.range(1).select(F.explode(F.expr("sequence(date'1995-02-01', date'2001-06-01', interval 1 month)")).alias("date"))
    due = ledgers.first_on_or_after(planned, nav.select("date")).where("used IS NOT NULL").groupBy(F.col("used").alias("date")).agg(F.count("*").alias("planned"))
    first = nav.groupBy(F.trunc("date", "quarter").alias("q")).agg(F.min("date").alias("date")).select("date", F.lit(0.01).alias("cash_per_unit"),
        F.when(F.month("date") == 7, 2.0).otherwise(1.0).alias("split"))
    return nav.join(due, "date", "left").join(first, "date", "left").select("date", "nav", F.coalesce("planned", F.lit(0)).alias("planned"), "cash_per_unit", "split",
        F.lit(None).cast("date").alias("reinvest_date"))


def plans(s: SparkSession, *rows: tuple) -> DataFrame:
    return s.createDataFrame(list(rows), "plan string, mode string, distribution string, amount double, fee double")


EVENTS = """ev AS (SELECT min(date) AS date FROM nv GROUP BY date_trunc('quarter', date)), e AS (SELECT nv.date, nav, coalesce(k, 0) AS k,
    CASE WHEN ev.date IS NULL THEN 0 ELSE 0.01 END AS cash, CASE WHEN ev.date IS NOT NULL AND month(nv.date) = 7 THEN 2.0 ELSE 1.0 END AS split FROM nv LEFT
    JOIN b ON b.date = nv.date LEFT JOIN ev ON ev.date = nv.date)"""
add(
    "contributions_reinvested",
    f"""WITH {RET}, {NAV}, {EVENTS}, g AS (SELECT *, exp(sum(ln(split + cash / nav)) OVER (ORDER BY date)) AS g
    FROM e), u AS (SELECT *, g * sum(k * 100 / 1.015 / nav / g) OVER (ORDER BY date) AS units, sum(k) OVER (ORDER BY date) AS ks FROM g)
    SELECT 'p' AS plan, date, {r('units', '0 AS cash', 'ks * 100 AS invested', 'ks * (100 - 100 / 1.015) AS fees', 'units * nav AS value')} FROM u""",
    lambda s, d: ledgers.contributions(plan_days(s, d), plans(s, ("p", "amount", "reinvest", 100.0, 0.015))),
)
add(
    "contributions_in_units",
    f"""WITH {RET}, {NAV}, {EVENTS}, g AS (SELECT *, exp(sum(ln(split)) OVER (ORDER BY date)) AS g FROM e), u AS (SELECT *, g * sum(k * 3 / g) OVER (ORDER BY date) AS units,
    sum(k * 3 * nav * 1.01) OVER (ORDER BY date) AS paid, sum(k * 3 * nav * 0.01) OVER (ORDER BY date) AS fees FROM g),
    c AS (SELECT *, sum(cash * (units - k * 3) / split) OVER (ORDER BY date) AS kept FROM u)
    SELECT 'u' AS plan, date, {r('units', 'kept AS cash', 'paid AS invested', 'fees', 'units * nav + kept AS value')} FROM c""",
    lambda s, d: ledgers.contributions(plan_days(s, d), plans(s, ("u", "units", "cash", 3.0, 0.01))),
)
add(
    "asof_backward",
    f"""WITH {RET}, p AS (SELECT m::DATE AS date FROM unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2001-12-31',
    INTERVAL 7 DAY)) g(m)), u AS (SELECT p.date, (SELECT max(x.date) FROM ret x WHERE x.date <= p.date) AS used FROM p) SELECT date,
    CASE WHEN date - used <= 3 THEN used END AS used FROM u""",
    lambda s, d: ledgers.last_on_or_before(s.range(1).select(F.explode(F.expr("sequence(date'1994-12-01', date'2001-12-31', interval 7 days)")).alias("date")),
        v.ret(s, d).select("date").distinct(), 3),
)


# Accounts that trade fixed amounts, and what isn't known of them.
def held(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = v.table(s, d, "lineitem")
    holdings = li.select(F.col("l_suppkey").alias("account"), F.year("l_shipdate").alias("ix"), F.col("l_returnflag").alias("security")).distinct()
    known = v.ret(s, d).groupBy(F.year("date").alias("ix"), F.col("asset").alias("security")).agg((F.product(1 + F.col("r")) - 1).alias("r")).where("NOT (ix = 1997 AND security = 'R')")
    rows = holdings.select("account").distinct().where("account % 4 <> 1").crossJoin(F.broadcast(known))
    full = holdings.select("account").distinct().where("account % 4 = 1").crossJoin(F.broadcast(v.ret(s, d).groupBy(F.year("date").alias("ix"),
        F.col("asset").alias("security")).agg((F.product(1 + F.col("r")) - 1).alias("r"))))
    trades = holdings.select("account").distinct().select("account", F.when(F.col("account") % 9 != 0, F.lit(True)).alias("can_trade"))
    return holdings, rows.unionByName(full), trades


add(
    "account_status",
    f"""WITH {RET}, h AS (SELECT DISTINCT l_suppkey AS account, year(l_shipdate) AS ix, l_returnflag AS security
    FROM lineitem), k AS (SELECT DISTINCT year(date) AS ix, asset AS security FROM ret), g AS (SELECT account, bool_or(k.ix IS NULL OR (account % 4 <> 1 AND h.ix = 1997
    AND h.security = 'R')) AS gap FROM h LEFT JOIN k ON k.ix = h.ix AND k.security = h.security GROUP BY account)
    SELECT account, CASE WHEN account % 9 = 0 THEN 'blocked_or_unknown' WHEN gap THEN 'unknown' WHEN account % 2 = 0 THEN 'conditional_on_declared_inputs' ELSE 'unknown_cost' END AS status FROM g""",
    lambda s, d: ledgers.notional_status(*held(s, d), F.col("account") % 2 == 0, "account"),
)


def equity(s: SparkSession, d: str) -> DataFrame:
    m = v.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("account"),
        F.trunc("o_orderdate", "MM").alias("ix")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("x"))
    w = Window.partitionBy("account").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("account", "ix", (1e9 + F.sum("x").over(w)).alias("net"))


add(
    "net_drawdown",
    f"""WITH m AS (SELECT o_orderpriority AS account, date_trunc('month', o_orderdate)::DATE AS ix, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) AS x
    FROM orders GROUP BY ALL), n AS (SELECT account, ix, 1e9 + sum(x) OVER (PARTITION BY account ORDER BY ix) AS net FROM m) SELECT account, {r('max(f) AS max_drawdown')}
    FROM (SELECT account, 1 - net / greatest(1e9, max(net) OVER (PARTITION BY account ORDER BY ix)) AS f FROM n) GROUP BY account""",
    lambda s, d: ledgers.net_drawdown(equity(s, d), 1e9, "account"),
)


def two_paths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = ledgers.buy_and_hold(v.ret(s, d), s.createDataFrame([("A", 0.3), ("N", 0.3), ("R", 0.3)], "asset string, w double"), 100.0)
    other = path.where(F.dayofyear("date") != 100).select("date", F.when(F.dayofmonth("date") == 1, F.col("value") + 0.5).otherwise(F.col("value")).alias("value"), "r")
    return path, other


add(
    "path_comparison",
    f"""WITH {RET}, p AS (SELECT date, 10 + sum(30 * nav) AS value FROM path GROUP BY date), q AS (SELECT date, value, dayofyear(date) <> 100 AS kept,
    CASE WHEN day(date) = 1 THEN 0.5 ELSE 0 END AS off FROM p)
    SELECT field, 0::BIGINT AS missing, (SELECT count(*) FROM q WHERE NOT kept)::BIGINT AS extra, {r('largest')}, false AS agrees FROM (SELECT 'value' AS field, (SELECT max(off)
    FROM q WHERE kept) AS largest UNION ALL SELECT 'r', 0.0)""",
    lambda s, d: ledgers.compared_paths(*two_paths(s, d)),
)


# Studies of events with a benchmark and trading conditions.
PATTERNS, HORIZONS = ["rise", "fall", "none"], [1, 3, 5]


def studied(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("security").orderBy("at")
    bars = v.bars(s, d).withColumn("id", F.concat_ws("|", "security", F.date_format("at", "yyyyMMddHH"))).withColumn("k", F.row_number().over(w))
    pattern = F.when(F.col("close") > F.col("open"), "rise").otherwise("fall")
    flags = F.array(F.col("k") % 7 != 0, F.when(F.col("k") % 5 != 0, F.lit(True)))
    found = bars.select("id", pattern.alias("pattern"), F.when(pattern == "rise", 1).otherwise(-1).alias("direction"), evidence.execution_status(flags).alias("execution"))
    ahead = bars.select("id", "k", *((F.lead("close", h).over(w) / F.col("close") - 1).alias(f"y{h}") for h in (1, 3)))
    ahead = ahead.select("id", "k", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in (1, 3)))).alias("o")).select("id", "o.horizon", "o.y",
        F.when(F.col("k") % 3 != 0, 0.01).alias("benchmark")).where("y IS NOT NULL")
    return found, ahead


EVENT_STUDY = f"""{BARS}, kk AS (SELECT *, security || '|' || strftime(at, '%Y%m%d%H') AS id, row_number() OVER (PARTITION BY security ORDER BY at) AS k,
    lead(close) OVER (PARTITION BY security ORDER BY at) AS n1, lead(close, 3) OVER (PARTITION BY security ORDER BY at) AS n3 FROM bars),
oo AS (SELECT id, k, CASE WHEN close > open THEN 'rise' ELSE 'fall' END AS pattern, h AS horizon, CASE h WHEN 1 THEN n1 ELSE n3 END / close - 1 AS y
    FROM kk, (VALUES (1), (3)) x(h)),
es AS (SELECT pattern, horizon, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, avg((y > 0)::INT) AS positive, avg((sign(y) =
    CASE pattern WHEN 'rise' THEN 1 ELSE -1 END)::INT) AS aligned, min(y) AS worst, max(y) AS best, avg(CASE WHEN k % 3 <> 0 THEN y - 0.01 END) AS excess,
    count(CASE WHEN k % 3 <> 0 THEN 1 END) AS with_benchmark, count(CASE WHEN k % 3 = 0 THEN 1 END) AS without_benchmark, count(CASE WHEN k % 7 = 0 THEN 1 END) AS blocked,
    count(CASE WHEN k % 7 <> 0 AND k % 5 = 0 THEN 1 END) AS unknown, min(id) AS first_id FROM oo WHERE y IS NOT NULL GROUP BY ALL)"""
STUDY_COLUMNS = f"coalesce(n, 0)::BIGINT AS n, {r('mean', 'median', 'positive', 'aligned', 'worst', 'best', 'excess')}, coalesce(with_benchmark, 0)::BIGINT AS with_benchmark, coalesce(without_benchmark, 0)::BIGINT AS without_benchmark, coalesce(blocked, 0)::BIGINT AS blocked, coalesce(unknown, 0)::BIGINT AS unknown, first_id"
add(
    "event_study",
    f"""WITH {EVENT_STUDY} SELECT p.pattern, z.horizon::BIGINT AS horizon, {STUDY_COLUMNS} FROM (VALUES ('rise'), ('fall'), ('none')) p(pattern) CROSS
    JOIN (VALUES (1), (3), (5)) z(horizon) LEFT JOIN es ON es.pattern = p.pattern AND es.horizon = z.horizon""",
    lambda s, d: candles.event_study(*studied(s, d), HORIZONS, PATTERNS),
)
add("first_groups", f"""WITH {EVENT_STUDY} SELECT pattern, horizon::BIGINT AS horizon, n::BIGINT AS n FROM es ORDER BY pattern, horizon LIMIT 3""", lambda s,
    d: candles.first_groups(candles.event_study(*studied(s, d), HORIZONS, PATTERNS), 3).select("pattern", "horizon", "n"))
add(
    "omitted_horizons",
    f"""WITH {EVENT_STUDY}, mm AS (SELECT id, bool_or(horizon = 1) AS h1, bool_or(horizon = 3) AS h3 FROM oo WHERE y IS NOT NULL GROUP BY id)
    SELECT id, (CASE WHEN h1 THEN 0 ELSE 1 END + CASE WHEN h3 THEN 0 ELSE 1 END + 1)::BIGINT AS n, CASE WHEN h1 THEN '' ELSE '1,' END ||
    CASE WHEN h3 THEN '' ELSE '3,' END || '5' AS omitted FROM mm""",
    lambda s, d: candles.omitted_horizons(studied(s, d)[1], HORIZONS).select("id", F.size("omitted").alias("n"),
        F.array_join(F.array_sort(F.col("omitted").cast("array<string>")), ",").alias("omitted")),
)
add(
    "prediction_metrics",
    f"""WITH {PANEL} SELECT signal_date, n::BIGINT AS n, {r('avg((factor - fwd) ** 2) AS mse', 'CASE WHEN n >= 3 THEN covar_pop(fr, yr) / nullif(stddev_pop(fr) * stddev_pop(yr), 0) END AS rank_ic')} FROM ranked GROUP BY signal_date, n""",
    lambda s, d: factors.prediction_metrics(v.panel(s, d)),
)


# Guards and sums.
def split_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = v.ret(s, d)
    return x.where("asset = 'A'").select("date", F.col("r").alias("a")), x.where("asset = 'N'").select("date", F.col("r").alias("n"))


add("strict_alignment", f"""WITH {RET} SELECT a.date, {r('a.r AS a', 'b.r AS n')} FROM ret a JOIN ret b USING (date) WHERE a.asset = 'A' AND b.asset = 'N'""", lambda s,
    d: returns.aligned(*split_tables(s, d)))
add("complete_months", f"""WITH {RET}, m AS (SELECT DISTINCT date_trunc('month', date)::DATE AS date FROM ret) SELECT year(date)::BIGINT AS year, count(*)::BIGINT AS n, count(*) = 12
    AND month(min(date)) = 1 AND month(max(date)) = 12 AS covered FROM m GROUP BY 1""", lambda s, d: returns.complete_months(v.ret(s, d).select(F.trunc("date", "MM").alias("date")).distinct()))
add(
    "conservation",
    "SELECT o_orderpriority AS owner, sum(o_totalprice::DECIMAL(38,2))::DOUBLE AS total, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders GROUP BY 1",
    lambda s, d: returns.unique_rows(v.table(s, d, "orders"), "o_orderkey").groupBy(F.col("o_orderpriority").alias("owner")).agg(returns.exact_sum(F.col("o_totalprice"), 2).alias("total"),
        F.countDistinct("o_orderkey").alias("n")),
)


# Scores of several factors over suppliers, by nation as industry.
def many(s: SparkSession, d: str) -> DataFrame:
    per = v.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("f2"), F.avg("l_quantity").alias("f3"),
        F.sum("l_extendedprice").alias("market_cap"))
    j = v.table(s, d, "supplier").join(per, "s_suppkey", "left")
    return j.select(F.lit("all").alias("snapshot"), F.col("s_suppkey").cast("string").alias("security"), "f1", "f2", F.when(F.col("s_suppkey") % 13 != 0, F.col("f3")).alias("f3"),
        F.concat(F.lit("i"), F.col("s_nationkey") % 4).alias("industry"), "market_cap")


add("multi_scores", None, lambda s, d: factors.multi_scores(many(s, d), ["f1", "f2", "f3"], {"f1": 0.5, "f2": -0.3, "f3": 0.2}, True, True, "snapshot"))
ZED = """m AS (SELECT s_suppkey AS k, avg(l_discount) AS f1, avg(l_tax) AS f2 FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), u AS (SELECT * FROM m
    WHERE f1 IS NOT NULL AND f2 IS NOT NULL), z AS (SELECT k, (f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER () AS z1, (f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER () AS z2
    FROM u)"""
add(
    "two_factor_scores",
    f"""WITH {ZED}, c AS (SELECT avg(z1 * z2) AS rho, count(*) AS n FROM z) SELECT 'all' AS snapshot, k::VARCHAR AS security, 'ok' AS status,
    {r('0.6 * z1 - 0.4 * z2 AS score', '1 / (1 - rho * rho) AS inflation')}, n::BIGINT AS n_used, ((SELECT count(*) FROM m) - n)::BIGINT AS n_excluded FROM z, c""",
    lambda s, d: factors.multi_scores(many(s, d).drop("f3"), ["f1", "f2"], {"f1": 0.6, "f2": -0.4}, False, False, "snapshot"),
)
add(
    "orthogonal_scores",
    f"""WITH {ZED}, c AS (SELECT avg(z1 * z2) AS rho, count(*) AS n FROM z) SELECT 'all' AS snapshot, k::VARCHAR AS security, 'ok' AS status,
    {r('0.6 * z1 - 0.4 * (z2 - rho * z1) / sqrt(1 - rho * rho) AS score', '1 / (1 - rho * rho) AS inflation')}, n::BIGINT AS n_used, ((SELECT count(*)
    FROM m) - n)::BIGINT AS n_excluded FROM z, c""",
    lambda s, d: factors.multi_scores(many(s, d).drop("f3"), ["f1", "f2"], {"f1": 0.6, "f2": -0.4}, False, True, "snapshot"),
)
#: Duration and convexity of a bond for a change of its yield.
add(
    "convexity_shock",
    f"""SELECT c_custkey AS id, scenario, {r('-(c_custkey % 10) * dy + 0.5 * (c_custkey % 70) * dy * dy AS change')} FROM customer, (VALUES ('up', 0.01), ('down', -0.005)) x(scenario,
    dy)""",
    lambda s, d: v.table(s, d, "customer").crossJoin(F.broadcast(s.createDataFrame([("up", 0.01), ("down", -0.005)], "scenario string, dy double"))).select(F.col("c_custkey").alias("id"),
        "scenario", risk.rate_shock(F.col("c_custkey") % 10, F.col("c_custkey") % 70, F.col("dy")).alias("change")),
)
add(
    "historical_holding",
    f"""WITH {RET}, h AS (SELECT asset, y, exp(sum(ln(1 + r)) OVER (PARTITION BY asset, y ORDER BY date ROWS BETWEEN CURRENT ROW
    AND 251 FOLLOWING)) - 1 AS held, count(*) OVER (PARTITION BY asset, y ORDER BY date ROWS BETWEEN CURRENT ROW AND 251 FOLLOWING) AS k FROM ret, (VALUES (1)) t(y))
    SELECT asset, count(*)::BIGINT AS n, {r('avg((held < 0)::INT) AS loss_share')} FROM h WHERE k = 252 GROUP BY asset""",
    lambda s, d: risk.rolling_holding(v.ret(s, d), 252, 1.0, "asset").select("asset", "n", "loss_share"),
)


# Observations: line items as rows of 17 text fields.
def observed(s: SparkSession, d: str) -> DataFrame:
    k, day = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.to_date("l_shipdate")
    text = lambda days: F.date_format(F.date_add(day, days), "yyyy-MM-dd")
    at = lambda days, tail: F.concat(text(days), F.lit(tail))
    named = {
        "id": k.cast("string"),
        "entity": F.concat(F.lit("part"), "l_partkey"),
        "metric": F.when(k % 31 != 0, "price").otherwise(" "),
        "value": F.when(k % 29 != 0, F.col("l_extendedprice").cast("decimal(20,2)").cast("string")).otherwise("n/a"),
        "unit": F.lit("base"),
        "currency": F.when(k % 23 == 0, "EUR").when(k % 2 == 0, "CNY"),
        "basis": F.lit("list"),
        "periodStart": text(0),
        "periodEnd": F.when(k % 19 != 0, text(1)).otherwise(text(-1)),
        "observedAt": F.lit(None).cast("string"),
        "publishedAt": F.when(k % 3 != 0, at(2, "T00:00:00Z")),
        "availableAt": F.when(k % 5 != 0, at(3, "T00:00:00Z")),
        "retrievedAt": F.when(k % 17 != 0, at(5, "T08:00:00+08:00")).otherwise(text(5)),
        "sourceUrl": F.lit("https://x.example/t"),
        "sourceVersion": F.lit("1"),
        "locator": F.lit("row"),
        "verification": F.lit("declared-not-original-verified"),
    }
    return v.table(s, d, "lineitem").select(*(c.alias(n) for n, c in named.items()))


def told(s: SparkSession, d: str) -> DataFrame:
    from ..sources import observations

    return observations.reason(observed(s, d)).select("id", "reason")


add("observation_contract", """WITH k AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k, l_orderkey, l_linenumber FROM lineitem), a AS (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem)
    SELECT k::VARCHAR AS id,
    CASE WHEN k % 31 = 0 THEN 'blank_field' WHEN k % 23 = 0 THEN 'unknown_currency' WHEN k % 29 = 0 THEN 'no_decimal' WHEN k % 19 = 0 THEN 'period' WHEN k % 17 = 0 THEN 'no_instant' END AS reason FROM a""", told)


def late(s: SparkSession, d: str) -> DataFrame:
    from ..sources import observations

    rest = [c for c in observations.FIELDS if c not in ("id", "periodStart")]
    # The earliest row of an id that holds. A filter by reason would be drawn below the columns that make the texts, and make them again for each rule.
    first = F.min(F.when(F.col("reason").isNull(), F.struct("periodStart", *rest))).alias("r")
    good = observations.reason(observed(s, d)).groupBy("id").agg(first).where("r IS NOT NULL").select("id", "r.*")
    out, unknown = observations.validated(good, F.lit(dt.datetime(1998, 6, 1)))
    return out.withColumn("kind", F.lit("excluded")).unionByName(unknown.withColumn("kind", F.lit("unknown"))).groupBy("kind").agg(F.count("*").alias("n"))


add(
    "observation_cutoff",
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_shipdate::DATE AS d FROM lineitem), g AS (SELECT k, min(d) AS d, count(*) AS c FROM a WHERE k % 31 <> 0 AND k % 23 <> 0
    AND k % 29 <> 0 AND k % 19 <> 0 AND k % 17 <> 0 GROUP BY k)
    SELECT 'excluded' AS kind, count(*)::BIGINT AS n FROM g WHERE d + 5 > DATE '1998-06-01' OR (k % 5 <> 0 AND d + 3 > DATE '1998-06-01') UNION ALL
    SELECT 'unknown', count(*)::BIGINT FROM g WHERE k % 5 = 0""",
    late,
)
