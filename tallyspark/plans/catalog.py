"""Queries of the operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, candles, factors, ledgers, returns, risk, solve
from . import views as v
from .registry import QUERIES, SQL, add, r, rounded

#: SQL of the views.
RET = """daily AS (SELECT l_returnflag AS asset, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS px FROM lineitem GROUP BY ALL),
px AS (SELECT * FROM daily WHERE date IN (SELECT date FROM daily GROUP BY date HAVING count(*) = (SELECT count(DISTINCT asset) FROM daily))),
ret AS (SELECT date, asset, r FROM (SELECT date, asset, greatest(-0.2, least(0.2, 0.05 * ln(px / lag(px) OVER (PARTITION BY asset ORDER BY date)))) AS r FROM px)
    WHERE r IS NOT NULL),
path AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER w) AS underwater FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY date)) AS nav FROM ret)
    WINDOW w AS (PARTITION BY asset ORDER BY date))"""
PANEL = """panel AS (SELECT * EXCLUDE v FROM (SELECT *, lead(v) OVER (PARTITION BY security ORDER BY signal_date) / v - 1 AS fwd
    FROM (SELECT date_trunc('month', l_shipdate)::DATE AS signal_date, l_suppkey AS security, round(avg(l_discount), 10) AS factor, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL))
    WHERE fwd IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY signal_date ORDER BY factor) + (count(*) OVER (PARTITION BY signal_date,
    factor) - 1) / 2.0 AS fr, rank() OVER (PARTITION BY signal_date ORDER BY fwd) + (count(*) OVER (PARTITION BY signal_date,
    fwd) - 1) / 2.0 AS yr, count(*) OVER (PARTITION BY signal_date) AS n FROM panel),
bucketed AS (SELECT *, least(5, floor((fr - 1) * 5 / n) + 1)::INT AS bucket FROM ranked),
info AS (SELECT signal_date, count(*) AS n, covar_pop(factor, fwd) / nullif(stddev_pop(factor) * stddev_pop(fwd), 0) AS ic,
    covar_pop(fr, yr) / nullif(stddev_pop(fr) * stddev_pop(yr), 0) AS rank_ic, avg(fwd) FILTER (bucket = 5) - avg(fwd) FILTER (bucket = 1) AS spread FROM bucketed
    GROUP BY signal_date)"""
BARS = """bars AS (SELECT event_type AS security, date_trunc('hour', ts) AS at, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL),
m AS (SELECT *, high - low AS span, abs(close - open) AS body, high - greatest(open, close) AS upper, least(open, close) - low AS lower,
    sign(close - open)::DOUBLE AS sign, abs(close - open) / nullif(high - low, 0) AS body_ratio FROM bars)"""
GRAPH = """c AS (SELECT c_name, n_name, r_name, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0),
s AS (SELECT 'world' AS node, r_name AS child, 'fund' AS kind, sum(b) AS b FROM c GROUP BY ALL UNION ALL SELECT r_name, n_name, 'fund', sum(b) FROM c GROUP BY ALL UNION ALL
    SELECT n_name, c_name, 'stock', sum(b) FROM c GROUP BY ALL),
edges AS (SELECT node, child, kind, 0.9 * b / sum(b) OVER (PARTITION BY node) AS weight FROM s),
walk AS (SELECT 'world' AS node, 'fund' AS kind, 1.0::DOUBLE AS w UNION ALL SELECT e.child, e.kind, w.w * e.weight FROM walk w JOIN edges e ON e.node = w.node
    WHERE w.kind = 'fund')"""
POSITIONS = """pos AS (SELECT c_name AS security, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS issuer, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS industry,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'bond' WHEN 'FURNITURE' THEN 'cash' ELSE 'stock' END AS kind, c_acctbal AS amount,
    CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 10)::DOUBLE END AS duration FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)"""


EQUAL = {"A": 0.3, "N": 0.3, "R": 0.3}


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EQUAL.items()), "asset string, w double")


# Returns and risk
add("returns_pct", f"""WITH {RET} SELECT date, asset, {r('x AS r')} FROM (SELECT date, asset, px / lag(px) OVER (PARTITION BY asset ORDER BY date) - 1 AS x FROM px) WHERE x IS NOT NULL""",
    lambda s, d: returns.pct_change(v.prices(s, d)))
add("nav_path", f"WITH {RET} SELECT asset, date, {r('nav')} FROM path", lambda s, d: risk.nav_path(v.ret(s, d), "asset").select("asset", "date", "nav"))
add("drawdown_path", f"WITH {RET} SELECT asset, date, {r('underwater')} FROM path", lambda s, d: risk.drawdown_path(v.ret(s, d), "asset").select("asset", "date", "underwater"))
add(
    "risk_card",
    f"""WITH {RET}, a AS (SELECT asset, count(*) AS n, sum(ln(1 + r)) AS l, avg(r - x.f) AS m, stddev_samp(r - x.f) AS sd, sqrt(avg(least(r - x.f,
    0) ** 2)) AS dn, max(underwater) AS mdd, sum(underwater ** 2) AS dp FROM path, (SELECT 1.02 ** (1 / 252.0) - 1 AS f) x GROUP BY asset)
    SELECT asset, n::BIGINT AS n, {r('exp(l) - 1 AS twr', 'exp(l * 252 / n) - 1 AS cagr', 'sd * sqrt(252) AS volatility', 'm * sqrt(252) / sd AS sharpe', 'm * sqrt(252) / dn AS sortino', '(exp(l * 252 / n) - 1) / mdd AS calmar', 'mdd AS max_drawdown', 'sqrt(dp / (n + 1)) AS ulcer')} FROM a""",
    lambda s, d: risk.summary(v.ret(s, d), "asset", risk_free=0.02),
)
add(
    "tail_es",
    f"""WITH {RET}, t AS (SELECT asset, -r AS loss, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY -r DESC, date) AS k FROM ret)
    SELECT asset, max(n)::BIGINT AS n, {r('sum(loss * greatest(0, least(1, (1 - 0.95) * n - (k - 1)))) / sum(greatest(0, least(1, (1 - 0.95) * n - (k - 1)))) AS es', 'quantile_cont(loss, 0.95) AS var')}, CASE WHEN (1 - 0.95) * max(n) < 30 THEN 'insufficient_data' ELSE 'ok' END AS status FROM t GROUP BY asset""",
    lambda s, d: risk.expected_shortfall(v.ret(s, d), "asset"),
)
add("worst_month", f"""WITH {RET}, m AS (SELECT asset, date_trunc('month', date)::DATE AS month, exp(sum(ln(1 + r))) - 1 AS x FROM ret GROUP BY ALL)
    SELECT asset, arg_min(month, x) AS month, {r('min(x) AS r')} FROM m GROUP BY asset""", lambda s, d: risk.worst_month(v.ret(s, d), "asset"))
add(
    "rolling_holding",
    f"""WITH {RET}, h AS (SELECT asset, exp(sum(ln(1 + r)) OVER w) - 1 AS held, count(*) OVER w AS k FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 251 PRECEDING))
    SELECT asset, count(*)::BIGINT AS n, {r('quantile_cont(held, 0.05) AS p05', 'quantile_cont(held, 0.5) AS median', 'quantile_cont(held, 0.95) AS p95', 'avg((held < 0)::INT) AS loss_share')} FROM h WHERE k = 252 GROUP BY asset""",
    lambda s, d: risk.rolling_holding(v.ret(s, d), 252, 1.0, "asset"),
)
add("train_test_split", f"""WITH {RET}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ret)) SELECT
    CASE WHEN k <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part, count(*)::BIGINT AS n, min(date) AS first, max(date) AS last FROM ret JOIN d USING (date) GROUP BY 1""", lambda s,
        d: returns.split_by_position(v.ret(s, d), 0.7).groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))
add("coverage_gate", f"""WITH {RET} SELECT year(date)::BIGINT AS year, count(*)::BIGINT AS n, min(date) AS first, max(date) AS last, count(*) >= 200 AND dayofyear(min(date)) <= 10
    AND month(max(date)) = 12 AND day(max(date)) >= 20 AS covered FROM (SELECT DISTINCT date FROM ret) GROUP BY 1""", lambda s, d: returns.coverage(v.ret(s, d).select("date").distinct()))
add(
    "frequency_quality",
    f"""WITH {RET}, g AS (SELECT asset, date - lag(date) OVER w AS gap, (year(date) * 12 + month(date)) - lag(year(date) * 12 + month(date)) OVER w AS step FROM ret
    WINDOW w AS (PARTITION BY asset ORDER BY date))
    SELECT asset, {r('quantile_cont(gap, 0.5) AS median_gap')}, max(gap)::BIGINT AS max_gap, CASE WHEN bool_and(step = 1) THEN 'monthly' WHEN quantile_cont(gap, 0.5) <= 4
    AND max(gap) <= 14 THEN 'daily' ELSE 'irregular' END AS frequency FROM g WHERE gap IS NOT NULL GROUP BY asset""",
    lambda s, d: returns.frequency(v.ret(s, d), "asset"),
)
add(
    "calendar_gaps",
    """WITH o AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), l AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem) SELECT date, 'missing' AS kind FROM l
    WHERE date NOT IN (SELECT date FROM o) UNION ALL SELECT date, 'unexpected' FROM o WHERE date NOT IN (SELECT date FROM l)""",
    lambda s, d: returns.calendar_gaps(v.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")), v.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))),
)


def nav_events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nav = risk.nav_path(v.ret(s, d), "asset").select(F.col("asset").alias("code"), "date", "nav")
    first = nav.groupBy("code", F.trunc("date", "quarter").alias("q")).agg(F.min("date").alias("date")).join(nav.groupBy("code").agg(F.min("date").alias("date")), ["code", "date"], "left_anti")
    return nav, first.select("code", "date", F.lit(0.01).alias("cash"), F.when(F.month("date") == 7, 2.0).otherwise(1.0).alias("split"))


add(
    "total_return_index",
    f"""WITH {RET}, q AS (SELECT asset, min(date) AS date FROM ret GROUP BY asset, date_trunc('quarter', date) HAVING min(date) > (SELECT min(date) FROM ret)),
    u AS (SELECT p.asset, p.date, nav, exp(sum(ln(CASE WHEN q.date IS NULL THEN 1 ELSE (CASE WHEN month(p.date) = 7 THEN 2 ELSE 1 END) + 0.01 / nav END)) OVER (PARTITION BY p.asset ORDER BY p.date)) AS units FROM path p LEFT JOIN q ON q.asset = p.asset AND q.date = p.date)
    SELECT asset AS code, date, {r("ln(units * nav / first_value(nav) OVER (PARTITION BY asset ORDER BY date)) AS log_index")} FROM u""",
    lambda s, d: returns.total_return_index(*nav_events(s, d)).select("code", "date", F.ln("index").alias("log_index")),
)
CLOSE = """cl AS (SELECT date, avg(px) / 1000 AS close FROM px WHERE day(date) % 2 = 0 GROUP BY date), nv AS (SELECT date, avg(px) / 1000 AS nav FROM px WHERE asset = 'A'
    AND day(date) % 3 <> 0 GROUP BY date)"""


def close_and_nav(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = v.prices(s, d)
    even = px.where(F.dayofmonth("date") % 2 == 0).groupBy("date").agg((F.avg("px") / 1000).alias("close"))
    return even, px.where((F.col("asset") == "A") & (F.dayofmonth("date") % 3 != 0)).groupBy("date").agg((F.avg("px") / 1000).alias("nav"))


add("premium_join", f"WITH {RET}, {CLOSE} SELECT date, {r('close / nav - 1 AS premium')} FROM cl JOIN nv USING (date)", lambda s, d: returns.premium(*close_and_nav(s, d))[0])
add("premium_missing", f"WITH {RET}, {CLOSE} SELECT date FROM cl ANTI JOIN nv USING (date)", lambda s, d: returns.premium(*close_and_nav(s, d))[1])
COV = "cov AS (SELECT a.asset AS i, b.asset AS j, covar_pop(a.r, b.r) AS v, count(*) AS n FROM ret a JOIN ret b USING (date) GROUP BY ALL)"
add("cov_population", f"WITH {RET}, {COV} SELECT i, j, n::BIGINT AS n, {r('v * 1000 AS v')} FROM cov", lambda s, d: risk.covariance(v.ret(s, d)).withColumn("v", F.col("v") * 1000))
add("factor_corr", f"""WITH {RET} SELECT a.asset AS i, b.asset AS j, {r('corr(a.r, b.r) AS c')} FROM ret a JOIN ret b USING (date) WHERE a.asset < b.asset GROUP BY ALL""", lambda s,
    d: correlations(v.ret(s, d)))


def correlations(ret: DataFrame) -> DataFrame:
    cov = risk.covariance(ret)
    var = cov.where("i = j").select(F.col("i").alias("k"), F.sqrt("v").alias("s"))
    return cov.where("i < j").join(F.broadcast(var.toDF("i", "si")), "i").join(F.broadcast(var.toDF("j", "sj")), "j").select("i", "j",
        (F.col("v") / F.nullif(F.col("si") * F.col("sj"), F.lit(0.0))).alias("c"))


add(
    "cov_ledoit_wolf",
    f"""WITH {RET}, x AS (SELECT date, asset, r - avg(r) OVER (PARTITION BY asset) AS x FROM ret), s AS (SELECT a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s,
    avg((a.x * b.x) ** 2) AS q, count(*) AS n FROM x a JOIN x b USING (date) GROUP BY ALL),
    o AS (SELECT sqrt(count(*)) AS p, sum(s) FILTER (i = j) AS tr, sum(s * s) AS ss, sum(q) AS qq, max(n) AS n
    FROM s), k AS (SELECT tr / p AS mu, (ss - p * (tr / p) ** 2) / p AS d2, (qq - ss) / (p * n) AS b2 FROM o), f AS (SELECT mu,
    CASE WHEN b2 <= 0 THEN 0 ELSE least(b2, d2) / d2 END AS rho FROM k)
    SELECT i, j, {r('1000 * ((1 - rho) * s + CASE WHEN i = j THEN rho * mu ELSE 0 END) AS v', 'rho AS shrinkage')} FROM s, f""",
    lambda s, d: risk.ledoit_wolf(v.ret(s, d)).withColumn("v", F.col("v") * 1000),
)
add("risk_contrib", f"""WITH {RET}, {COV}, e AS (SELECT i, sum(0.3 * v * 0.3) AS c FROM cov GROUP BY i) SELECT i AS asset, {r('0.3 AS w', 'c / sum(c) OVER () AS share')} FROM e""", lambda s,
    d: risk.risk_contributions(risk.covariance(v.ret(s, d)), weights(s)))
add(
    "concentration",
    f"""WITH {RET}, {COV}, e AS (SELECT i, sum(0.09 * v) AS c FROM cov GROUP BY i)
    SELECT {r('0.81 / 0.27 AS weight_assets', '(SELECT sum(c) ** 2 / sum(c * c) FROM e) AS risk_assets', '(SELECT sum(0.3 * sqrt(v)) FROM cov WHERE i = j) / (SELECT sqrt(sum(c)) FROM e) AS diversification', '0.1 AS cash')}""",
    lambda s, d: risk.concentration(risk.covariance(v.ret(s, d)), weights(s)),
)
add(
    "alloc_two_asset",
    f"""WITH {RET}, {COV}, o AS (SELECT max(v) FILTER (i = 'A' AND j = 'A') AS a, max(v) FILTER (i = 'N' AND j = 'N') AS b, max(v) FILTER (i = 'A' AND j = 'N') AS c
    FROM cov), w AS (SELECT 'min_variance' AS method, greatest(0, least(1, (b - c) / (a + b - 2 * c))) AS w FROM o UNION ALL
    SELECT unnest(['risk_parity', 'max_diversification']), sqrt(b) / (sqrt(a) + sqrt(b)) FROM o)
    SELECT method, 'A' AS asset, {r('w')} FROM w UNION ALL SELECT method, 'N', {r('1 - w AS w')} FROM w""",
    lambda s, d: risk.two_asset_weights(risk.covariance(v.ret(s, d)), "A", "N"),
)
add(
    "bl_single_view",
    f"""WITH {RET}, {COV}, e AS (SELECT i, 2.5 * sum(v * 0.3) AS prior, sum(v * CASE j WHEN 'A' THEN 1 WHEN 'N' THEN -1 ELSE 0 END) AS cp FROM cov
    GROUP BY i), o AS (SELECT sum(CASE i WHEN 'A' THEN prior WHEN 'N' THEN -prior ELSE 0 END) AS told, sum(CASE i WHEN 'A' THEN cp WHEN 'N' THEN -cp ELSE 0 END) AS pcp FROM e)
    SELECT i AS asset, {r('1000 * prior AS prior', '1000 * (prior + 0.05 * cp * (0.001 - told) / (0.05 * pcp + 0.00001)) AS posterior')} FROM e, o""",
    lambda s, d: risk.black_litterman_one_view(risk.covariance(v.ret(s, d)), weights(s), {"A": 1.0, "N": -1.0}, 0.001, 0.00001, 0.05, 2.5).select("asset",
        (1000 * F.col("prior")).alias("prior"), (1000 * F.col("posterior")).alias("posterior")),
)
add("buy_hold_path", f"""WITH {RET}, p AS (SELECT date, 10 + sum(30 * nav) AS value FROM path GROUP BY date)
    SELECT date, {r('value', 'value / coalesce(lag(value) OVER (ORDER BY date), 100) - 1 AS r')} FROM p""", lambda s, d: ledgers.buy_and_hold(v.ret(s, d), weights(s), 100.0))


def yearly(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    years = v.ret(s, d).groupBy(F.year("date").alias("ix"), F.col("asset").alias("security")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
    trades = years.where("ix % 2 = 1").select("ix", "security", F.when(F.col("ix") == 1997, -2.0).otherwise(10.0).alias("notional"))
    return years.select("ix").distinct(), years, trades


YEARLY = """y AS (SELECT year(date) AS ix, asset AS security, exp(sum(ln(1 + r))) - 1 AS r FROM ret GROUP BY ALL), t AS (SELECT ix, security,
    CASE WHEN ix = 1997 THEN -2.0 ELSE 10.0 END AS notional FROM y WHERE ix % 2 = 1),
h AS (SELECT y.ix, sum(t.notional * (SELECT exp(sum(ln(1 + z.r))) FROM y z WHERE z.security = t.security AND z.ix BETWEEN t.ix AND y.ix)) AS held FROM t
    JOIN y ON y.security = t.security AND y.ix >= t.ix GROUP BY y.ix),
k AS (SELECT i.ix, coalesce(held, 0) AS held, sum(coalesce(spent, 0)) OVER w AS spent, sum(coalesce(fee, 0)) OVER w AS fee FROM (SELECT DISTINCT ix FROM y) i LEFT
    JOIN h USING (ix) LEFT JOIN (SELECT ix, sum(notional) AS spent, sum(abs(notional)) AS fee FROM t GROUP BY ix) f USING (ix) WINDOW w AS (ORDER BY i.ix))"""
add("fixed_notional_ledger", f"""WITH {RET}, {YEARLY} SELECT ix::BIGINT AS ix, {r('100 - spent + held AS gross', '100 - spent + held - fee * 20 / 10000 AS net')} FROM k""", lambda s,
    d: ledgers.fixed_notional(*yearly(s, d), 100.0, bps=F.lit(20.0)))
add(
    "cost_sensitivity",
    f"""WITH {RET}, {YEARLY} SELECT bps::BIGINT AS bps, ix::BIGINT AS ix, {r('100 - spent + held AS gross', '100 - spent + held - fee * bps / 10000 AS net')}
    FROM k, (SELECT unnest([0, 10, 50]) AS bps)""",
    lambda s, d: costs(s, d),
)


def costs(s: SparkSession, d: str) -> DataFrame:
    periods, rets, trades = yearly(s, d)
    rates = s.range(1).select(F.explode(F.array(F.lit(0), F.lit(10), F.lit(50))).alias("bps"))
    return ledgers.fixed_notional(rates.crossJoin(periods), rets, trades.crossJoin(F.broadcast(rates)), 100.0, "bps", bps=F.col("bps"))


U = "(('0x' || substr(md5('11:' || path || ':' || step || ':{t}'), 1, 8))::BIGINT / 4294967296.0)"


def boot_sql(n: str, horizon: str) -> str:
    """Rows drawn out of ``n`` by 200 paths of ``horizon`` steps."""
    return f"""cells AS (SELECT p AS path, h AS step FROM range(200) a(p), LATERAL (SELECT unnest(range({horizon})) AS h) b), j AS (SELECT path, step,
    CASE WHEN step = 0 OR {U.format(t='restart')} < 1 / 10.0 THEN step END AS s, floor({U.format(t='start')} * {n}) AS u FROM cells),
k AS (SELECT *, max(s) OVER (PARTITION BY path ORDER BY step) AS b FROM j), boot AS (SELECT k.path, k.step, ((o.u + k.step - k.b)::BIGINT % {n}) AS row_ix FROM k
    JOIN k o ON o.path = k.path AND o.step = k.b)"""


BOOT = boot_sql("500", "60")
add("boot_indices", f"""WITH {BOOT} SELECT path::BIGINT AS path, step::BIGINT AS step, row_ix::BIGINT AS row_ix FROM boot""", lambda s, d: ledgers.bootstrap_rows(s, 500, 200, 60, 10.0, 11))


def boot_paths(s: SparkSession, d: str, horizon: int | None = None) -> DataFrame:
    """Paths drawn from all returns of A, of ``horizon`` steps or else as many as there are returns."""
    from pyspark.sql import Window

    rows = v.ret(s, d).where("asset = 'A'").withColumn("row_ix", F.row_number().over(Window.orderBy("date")) - 1).select("row_ix", "r")
    n = max(1, rows.count())
    drawn = ledgers.bootstrap_rows(s, n, 200, horizon or n, 10.0, 11).join(F.broadcast(rows), "row_ix")
    path = risk.drawdown_path(drawn.withColumnRenamed("step", "date"), "path")
    each = path.groupBy("path").agg(F.max("underwater").alias("mdd"), (F.product(1 + F.col("r")) - 1).alias("held"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    return each




def booted_sql(horizon: str) -> str:
    """Figures of 200 paths drawn out of all returns of A."""
    n = "(SELECT count(*) FROM ret WHERE asset = 'A')"
    return f"""{boot_sql(n, horizon or n)}, rows AS (SELECT r, row_number() OVER (ORDER BY date) - 1 AS row_ix FROM ret
    WHERE asset = 'A'), drawn AS (SELECT path, step, r, exp(sum(ln(1 + r)) OVER (PARTITION BY path ORDER BY step)) AS nav FROM boot JOIN rows USING (row_ix)),
dd AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER (PARTITION BY path ORDER BY step)) AS u FROM drawn), each AS (SELECT path, max(u) AS mdd, exp(sum(ln(1 + r))) - 1 AS held,
    avg(r) AS m, stddev_samp(r) AS sd FROM dd GROUP BY path)"""


add("boot_quantiles", f"""WITH {RET}, {booted_sql('60')}
    SELECT {r('quantile_cont(mdd, 0.95) AS p95', 'quantile_cont(mdd, 0.99) AS p99', 'avg((mdd > 0.1)::INT) AS exceeds', 'quantile_cont(held, 0.5) AS median')} FROM each""", lambda s,
        d: boot_paths(s, d, 60).agg(F.percentile("mdd", F.lit(0.95)).alias("p95"), F.percentile("mdd", F.lit(0.99)).alias("p99"), F.avg((F.col("mdd") > 0.1).cast("double")).alias("exceeds"),
            F.percentile("held", F.lit(0.5)).alias("median")))
add("boot_sharpe", f"""WITH {RET}, {booted_sql('')} SELECT {r('quantile_cont(m / sd, 0.025) AS low', 'quantile_cont(m / sd, 0.975) AS high')} FROM each""", lambda s,
    d: boot_paths(s, d).agg(F.percentile(F.col("m") / F.col("sd"), F.lit(0.025)).alias("low"), F.percentile(F.col("m") / F.col("sd"), F.lit(0.975)).alias("high")))
SEGMENTS = """seg AS (SELECT period, segment, v / sum(v) OVER (PARTITION BY period) AS wp, q / sum(q) OVER (PARTITION BY period) AS wb, rp, rb
    FROM (SELECT year(l_shipdate) AS period, l_returnflag AS segment, sum(l_extendedprice) AS v, sum(l_quantity) AS q, avg(l_discount) AS rp, avg(l_tax) AS rb FROM lineitem
    GROUP BY ALL)), br AS (SELECT s.period, sum((wp - wb) * (rb - t.b)) AS allocation, sum(wb * (rp - rb)) AS selection, sum((wp - wb) * (rp - rb)) AS interaction,
    sum(wp * rp) AS p, max(t.b) AS b FROM seg s JOIN (SELECT period, sum(wb * rb) AS b FROM seg GROUP BY period) t USING (period) GROUP BY s.period)"""
add("brinson_period", f"""WITH {SEGMENTS} SELECT period::BIGINT AS period, {r('allocation', 'selection', 'interaction', 'p', 'b')} FROM br""", lambda s, d: ledgers.brinson(v.segments(s, d)))
add(
    "brinson_linked",
    f"""WITH {SEGMENTS}, t AS (SELECT exp(sum(ln(1 + p))) - 1 AS tp, exp(sum(ln(1 + b))) - 1 AS tb
    FROM br), c AS (SELECT br.*, tp - tb AS excess, (ln(1 + p) - ln(1 + b)) / (p - b) / ((ln(1 + tp) - ln(1 + tb)) / (tp - tb)) AS k FROM br, t)
    SELECT {r('sum(k * allocation) AS allocation', 'sum(k * selection) AS selection', 'sum(k * interaction) AS interaction', 'max(excess) AS excess', 'max(excess) - sum(k * (allocation + selection + interaction)) AS residual')} FROM c""",
    lambda s, d: ledgers.brinson_linked(ledgers.brinson(v.segments(s, d))),
)
add(
    "ols_one_factor",
    f"""WITH {RET} SELECT {r('regr_slope(a.r, b.r) AS beta', 'regr_intercept(a.r, b.r) AS alpha', 'regr_r2(a.r, b.r) AS r2')} FROM ret a JOIN ret b USING (date) WHERE a.asset = 'A'
    AND b.asset = 'N'""",
    lambda s, d: pair(v.ret(s, d)).agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2")),
)


def pair(ret: DataFrame) -> DataFrame:
    return ret.where("asset = 'A'").select("date", F.col("r").alias("y")).join(ret.where("asset = 'N'").select("date", F.col("r").alias("x")), "date")


add(
    "stress_recovery",
    f"""WITH {RET}, p AS (SELECT asset, date, nav, 1 - nav / greatest(1, max(nav) OVER (PARTITION BY asset ORDER BY date)) AS u
    FROM (SELECT asset, date, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY date)) AS nav FROM ret WHERE date >= DATE '1997-03-01')),
    m AS (SELECT asset, max(u) AS mdd FROM p WHERE date <= DATE '1998-06-30' GROUP BY asset), t AS (SELECT asset, mdd, min(date) AS trough FROM p JOIN m USING (asset)
    WHERE u = mdd AND date <= DATE '1998-06-30' GROUP BY ALL),
    h AS (SELECT t.asset, mdd, trough, greatest(1, max(nav)) AS high FROM t JOIN p ON p.asset = t.asset AND p.date <= trough GROUP BY ALL), b AS (SELECT h.*, (SELECT min(date)
    FROM p WHERE p.asset = h.asset AND p.date > trough AND p.nav >= high - 1e-12) AS recovered FROM h)
    SELECT asset, {r('mdd AS max_drawdown')}, trough, recovered, {r('(recovered - trough) / 30.4375 AS months')},
    CASE WHEN recovered IS NULL THEN 'right_censored' ELSE 'recovered' END AS status FROM b""",
    lambda s, d: risk.recovery(v.ret(s, d), "1997-03-01", "1998-06-30", "asset"),
)


def alloc_all(s: SparkSession, d: str) -> DataFrame:
    """All allocation methods on the shrunk covariance of the three flags, which the driver holds as a 3 x 3 matrix."""
    rows = risk.ledoit_wolf(v.ret(s, d)).collect()
    names = sorted({r["i"] for r in rows})
    cov = np.zeros((len(names), len(names)))
    for r in rows:
        cov[names.index(r["i"]), names.index(r["j"])] = r["v"]
    found, _ = solve.allocations(cov)
    return s.createDataFrame([(m, a, float(w)) for m, ws in found.items() for a, w in zip(names, ws)], "method string, asset string, w double")


def daily_path(s: SparkSession, d: str) -> DataFrame:
    return v.ret(s, d).withColumn("path", F.lit("demo"))


add("alloc_all", None, alloc_all)
# A ledger that is never traded again is the buy-and-hold path: the first purchase is free of cost at rate 0.
add("backtest_hold", f"""WITH {RET}, p AS (SELECT date, 10 + sum(30 * nav) AS value FROM path GROUP BY date) SELECT date, {r('value', 'value / 100 AS nav')} FROM p""", lambda s,
    d: backtest.backtest(daily_path(s, d), EQUAL).select("date", "value", "nav"))
# Traded back to its weights every day at no cost, the portfolio's return is the mean of the returns.
add("backtest_daily", f"""WITH {RET}, p AS (SELECT date, sum(0.3 * r) AS g FROM ret GROUP BY date)
    SELECT date, {r('100 * exp(sum(ln(1 + g)) OVER (ORDER BY date)) AS value', 'exp(sum(ln(1 + g)) OVER (ORDER BY date)) AS nav')} FROM p""", lambda s,
        d: backtest.backtest(daily_path(s, d), EQUAL, every=1).select("date", "value", "nav"))
add("trial_audit", """SELECT o_orderstatus AS status, count(*)::BIGINT AS n, count(*) FILTER (o_orderkey % 9 = 0)::BIGINT AS selected,
    count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)::BIGINT AS leaks FROM orders GROUP BY 1""", lambda s, d: factors.trial_audit(trials(s, d)))


def trials(s: SparkSession, d: str) -> DataFrame:
    """Orders as trials: every fifth trains beyond its test's start, every seventh touched the test."""
    o, key, date = v.table(s, d, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    return o.select(F.col("o_orderstatus").alias("status"), (key % 9 == 0).alias("selected"), (key % 7 == 0).alias("test_touched"),
        F.when(key % 5 == 0, F.date_add(date, 40)).otherwise(date).alias("train_end"), F.date_add(date, 10).alias("label_end"), F.date_add(date, 30).alias("test_start"))


# Factor panels
add("panel_ic", f"WITH {PANEL} SELECT signal_date, n::BIGINT AS n, {r('ic', 'rank_ic', 'spread')} FROM info", lambda s, d: factors.information(v.panel(s, d)))
add("panel_buckets", f"""WITH {PANEL} SELECT signal_date, bucket::BIGINT AS bucket, count(*)::BIGINT AS n, {r('avg(fwd) AS fwd')} FROM bucketed GROUP BY ALL""", lambda s,
    d: factors.bucket_returns(v.panel(s, d)))
add("panel_summary", f"""WITH {PANEL} SELECT count(rank_ic)::BIGINT AS n_dates, {r('avg(rank_ic) AS mean_rank_ic', 'stddev_samp(rank_ic) AS std_rank_ic', 'avg(spread) AS mean_spread', 'avg(rank_ic) / stddev_samp(rank_ic) AS icir')} FROM info""", lambda s, d: factors.panel_summary(factors.information(v.panel(s, d))))
add("group_weights", f"""WITH {PANEL} SELECT signal_date, security, bucket::BIGINT AS bucket, {r('1.0 / count(*) OVER (PARTITION BY signal_date, bucket) AS w')} FROM bucketed""", lambda s,
    d: factors.group_weights(v.panel(s, d)))
add(
    "series_overlap",
    """WITH w AS (SELECT l_orderkey AS id, min(l_shipdate)::DATE AS start, max(l_shipdate)::DATE AS e FROM lineitem GROUP BY 1)
    SELECT id, start, e AS "end", coalesce(start < max(e) OVER (ORDER BY start, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM w""",
    lambda s, d: factors.overlaps(windows(s, d), "id"),
)


def windows(s: SparkSession, d: str) -> DataFrame:
    """The days from the first to the last shipment of every order."""
    return v.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end"))


add(
    "decay_curve",
    f"""WITH {PANEL}, hz AS (SELECT p.signal_date, p.security, p.factor, h.horizon, p.fwd * (1 + h.horizon / 10.0 * ((p.security % 3) - 1)) AS fwd
    FROM panel p, (SELECT unnest([1, 2]) AS horizon) h),
    rk AS (SELECT *, rank() OVER (PARTITION BY signal_date, horizon ORDER BY factor) + (count(*) OVER (PARTITION BY signal_date,
    horizon, factor) - 1) / 2.0 AS fr, rank() OVER (PARTITION BY signal_date, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY signal_date,
    horizon, fwd) - 1) / 2.0 AS yr, count(*) OVER (PARTITION BY signal_date, horizon) AS n FROM hz),
    i AS (SELECT horizon, signal_date, covar_pop(fr, yr) / nullif(stddev_pop(fr) * stddev_pop(yr),
    0) AS ic, avg(fwd) FILTER (least(5, floor((fr - 1) * 5 / n) + 1) = 5) - avg(fwd) FILTER (least(5, floor((fr - 1) * 5 / n) + 1) = 1) AS sp FROM rk GROUP BY ALL)
    SELECT horizon::BIGINT AS horizon, {r('avg(ic) AS rank_ic', 'avg(sp) AS spread')}, 'observed' AS status FROM i GROUP BY horizon UNION ALL SELECT 3, NULL, NULL, 'missing'""",
    lambda s, d: factors.decay(v.panel(s, d).crossJoin(s.range(1, 3).select(F.col("id").cast("int").alias("horizon"))).withColumn("fwd",
        F.col("fwd") * (1 + F.col("horizon") / 10 * (F.col("security") % 3 - 1))), [1, 2, 3]),
)
add(
    "stability",
    f"""WITH {PANEL}, x AS (SELECT signal_date AS at, 'g' || (month(signal_date) // 7) AS grp, CASE WHEN month(signal_date) <> 4 THEN round(rank_ic, 6) END AS ic FROM info),
    o AS (SELECT *, row_number() OVER (ORDER BY at) AS g, lag(ic) OVER w AS p FROM x WINDOW w AS (PARTITION BY grp ORDER BY at)), c AS (SELECT *,
    CASE WHEN ic IS NULL OR p IS NULL OR g - lag(g) OVER w > 1 THEN 1 ELSE 0 END AS cut FROM o WINDOW w AS (PARTITION BY grp ORDER BY at)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY grp ORDER BY at) AS island FROM c), k AS (SELECT * FROM i WHERE ic IS NOT NULL), f AS (SELECT *,
    CASE WHEN sign(ic) * lag(sign(ic)) OVER w < 0 THEN 1 ELSE 0 END AS flip, sum((ic > 0)::INT) OVER w AS run, sum(ic) OVER (PARTITION BY grp ORDER BY at) AS path FROM k
    WINDOW w AS (PARTITION BY grp, island ORDER BY at)),
    z AS (SELECT *, greatest(0, max(path) OVER (PARTITION BY grp ORDER BY at)) - path AS fall FROM f), n AS (SELECT grp, max(l) AS longest
    FROM (SELECT grp, island, run, sum((ic <= 0)::INT) AS l FROM f GROUP BY ALL) GROUP BY grp)
    SELECT grp, count(*)::BIGINT AS n, {r('avg((ic > 0)::INT) AS positive_share')}, sum(flip)::BIGINT AS flips, max(longest)::BIGINT AS longest_non_positive,
    {r('max(fall) AS greatest_fall')} FROM z JOIN n USING (grp) GROUP BY grp""",
    lambda s, d: factors.stability(factors.information(v.panel(s, d)).select(F.col("signal_date").alias("at"),
        F.concat(F.lit("g"), F.floor(F.month("signal_date") / 7).cast("string")).alias("grp"), F.when(F.month("signal_date") != 4, F.round("rank_ic", 6)).alias("ic"))),
)
add(
    "factor_exposure",
    """WITH h AS (SELECT s_suppkey AS security, CASE WHEN s_suppkey % 10 = 0 THEN 'cash' ELSE 'stock' END AS kind, abs(s_acctbal) / sum(abs(s_acctbal)) OVER () AS w
    FROM supplier), f AS (SELECT l_suppkey AS security, avg(l_discount) AS v FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1), a AS (SELECT sum(w) FILTER (kind <> 'cash'
    AND v IS NOT NULL) AS known, coalesce(sum(w) FILTER (kind <> 'cash' AND v IS NULL), 0) AS unknown, coalesce(sum(w) FILTER (kind = 'cash'),
    0) AS cash, sum(w * v) FILTER (kind <> 'cash') AS contribution FROM h LEFT JOIN f USING (security)) SELECT """
    + r("known", "unknown", "cash", "contribution", "contribution / known AS normalised", "CASE WHEN unknown <= 1e-12 THEN contribution END AS complete")
    + " FROM a",
    lambda s, d: factors.exposure(supplier_weights(s, d), v.table(s, d, "lineitem").where("l_suppkey % 4 <> 0").groupBy(F.col("l_suppkey").alias("security")).agg(F.avg("l_discount").alias("value"))),
)


def supplier_weights(s: SparkSession, d: str) -> DataFrame:
    t = v.table(s, d, "supplier")
    total = t.agg(F.sum(F.abs("s_acctbal")).alias("total"))
    return t.join(F.broadcast(total)).select(F.col("s_suppkey").alias("security"), F.when(F.col("s_suppkey") % 10 == 0, "cash").otherwise("stock").alias("kind"),
        (F.abs("s_acctbal") / F.col("total")).alias("weight"))


add("mid_percentile", "SELECT " + r("avg(CASE WHEN p_size < 25 THEN 100 WHEN p_size = 25 THEN 50 ELSE 0 END) AS percentile") + " FROM part", lambda s,
    d: factors.mid_percentile(v.table(s, d, "part").select(F.col("p_size").alias("value")), F.lit(25)))
add(
    "zscore_neutral",
    """WITH z AS (SELECT p_partkey AS security, p_type AS industry, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS z
    FROM part), n AS (SELECT *, z - avg(z) OVER (PARTITION BY industry) AS y FROM z) SELECT security, industry, """ + r("z", "(y - avg(y) OVER ()) / stddev_pop(y) OVER () AS neutral") + " FROM n",
    lambda s, d: factors.neutral_scores(v.table(s, d, "part").select(F.col("p_partkey").alias("security"), F.col("p_type").alias("industry"),
        F.col("p_retailprice").alias("value"))).select("security", "industry", "z", "neutral"),
)
AVAILABLE = "a AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE + (o_orderkey % 40)::INT END AS available FROM orders)"


def available(s: SparkSession, d: str) -> DataFrame:
    o = v.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"))).alias("available"))


CUT = "1998-07-01"
add("asof_included", f"WITH {AVAILABLE} SELECT id, available FROM a WHERE available <= DATE '1998-07-01'", lambda s, d: factors.cutoff(available(s, d), F.col("available"), F.lit(CUT).cast("date"))[0])
add("asof_excluded", f"""WITH {AVAILABLE} SELECT id, available, CASE WHEN available IS NULL THEN 'availability unknown' ELSE 'available after the cut-off' END AS reason FROM a
    WHERE available IS NULL OR available > DATE '1998-07-01'""", lambda s, d: factors.cutoff(available(s, d), F.col("available"), F.lit(CUT).cast("date"))[1])
add(
    "lookahead_violations",
    """SELECT count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 60 DAY)::BIGINT AS late_factor, count(*) FILTER (l_shipdate < o_orderdate)::BIGINT AS early_window,
    count(*) FILTER (l_linenumber < l_quantity)::BIGINT AS early_return, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    lambda s, d: factors.lookahead(v.table(s, d, "lineitem").join(v.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), F.col("o_orderdate") + F.expr("interval 60 days"),
        F.col("l_shipdate"), F.when(F.col("l_shipdate") < F.col("o_orderdate"), F.lit("1900-01-01").cast("timestamp")), F.col("l_quantity"),
            F.col("l_linenumber")).select(F.col("late_factor"), F.col("early_window"), "early_return", "n"),
)

# Look-through and exposure
add("lookthrough_leaves", f"WITH RECURSIVE {GRAPH} SELECT node AS leaf, {r('1000 * w AS w')} FROM walk WHERE kind <> 'fund'", lambda s,
    d: ledgers.lookthrough(v.graph(s, d), "world").where("kind <> 'unknown'").select("leaf", (1000 * F.col("w")).alias("w")))
add("lookthrough_unknown", f"""WITH RECURSIVE {GRAPH} SELECT 'undisclosed' AS reason, count(*)::BIGINT AS n, {r('sum(w * (1 - t.s)) AS w')} FROM walk JOIN (SELECT node, sum(weight) AS s FROM edges
    GROUP BY node) t USING (node) WHERE kind = 'fund'""", lambda s,
        d: ledgers.lookthrough(v.graph(s, d), "world").where("kind = 'unknown'").groupBy("reason").agg(F.count("*").alias("n"), F.sum("w").alias("w")))
add("issuer_rollup", f"""WITH RECURSIVE {GRAPH} SELECT c_mktsegment AS issuer, {r('sum(w) AS w')} FROM walk JOIN customer ON c_name = node WHERE kind = 'stock' GROUP BY 1""", lambda s,
    d: ledgers.lookthrough(v.graph(s, d), "world").where("kind = 'stock'").join(v.table(s, d, "customer"),
        F.col("leaf") == F.col("c_name")).groupBy(F.col("c_mktsegment").alias("issuer")).agg(F.sum("w").alias("w")))
add(
    "exposure_rollups",
    f"""WITH {POSITIONS}, e AS (SELECT *, CASE WHEN kind <> 'cash' THEN coalesce(issuer, 'unmapped') END AS i, CASE WHEN kind <> 'cash' THEN coalesce(industry, 'unmapped') END AS y
    FROM pos) SELECT 'security' AS level, security AS key, {r('sum(amount) AS amount')} FROM e GROUP BY 2 UNION ALL SELECT 'issuer', i, {r('sum(amount) AS amount')} FROM e
    WHERE i IS NOT NULL GROUP BY 2 UNION ALL SELECT 'industry', y, {r('sum(amount) AS amount')} FROM e WHERE y IS NOT NULL GROUP BY 2 UNION ALL
    SELECT 'kind', kind, {r('sum(amount) AS amount')} FROM e GROUP BY 2""",
    lambda s, d: ledgers.rollups(v.positions(s, d)),
)
add("rate_scenarios", f"""WITH {POSITIONS} SELECT scenario, {r('sum(-shock * duration * amount) AS change', 'sum(amount) FILTER (duration IS NOT NULL) AS covered', 'sum(amount) FILTER (duration IS NULL) AS unestimated')} FROM pos, (VALUES ('up', 0.01), ('down', -0.005)) x(scenario, shock) WHERE kind = 'bond' GROUP BY scenario""", lambda s, d: ledgers.rate_scenarios(v.positions(s, d), s.createDataFrame([("up", 0.01), ("down", -0.005)], "scenario string, shock double")))

# Cash
CASH = """f AS (SELECT o_orderpriority AS owner, o_orderdate::DATE AS date, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) AS net FROM orders GROUP BY ALL),
days AS (SELECT owner, least + g.d::INT AS date FROM (SELECT DISTINCT owner FROM f), (SELECT min(date) AS least, max(date) AS greatest
    FROM f), LATERAL (SELECT unnest(range(0, greatest - least + 1)) AS d) g),
led AS (SELECT owner, date, coalesce(net, 0) AS net, 1000000 + sum(coalesce(net, 0)) OVER (PARTITION BY owner ORDER BY date) AS balance FROM days LEFT
    JOIN f USING (owner, date))"""


def span(flows: DataFrame) -> DataFrame:
    """One row: the least and the greatest date."""
    return flows.agg(F.min("date").alias("least"), F.max("date").alias("greatest"))


def cash(s: SparkSession, d: str) -> DataFrame:
    o = v.table(s, d, "orders")
    flows = o.select(F.col("o_orderpriority").alias("owner"), F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"))
    days = flows.select("owner").distinct().crossJoin(F.broadcast(span(flows))).select("owner", F.explode(F.sequence("least", "greatest")).alias("date"))
    return ledgers.cash_ledger(flows, days, F.lit(1_000_000.0), "owner")


def cents(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 2) for c in cols})


add("cash_daily_ledger", f"""WITH {CASH} SELECT owner, date, round(net, 2) + 0.0 AS net, round(balance, 2) + 0.0 AS balance, round(greatest(0, -balance), 2) + 0.0 AS gap FROM led""",
    lambda s, d: cents(cash(s, d), "net", "balance", "gap"))
add("cash_first_gap", f"""WITH {CASH} SELECT owner, min(date) FILTER (balance < 0) AS first_gap, round(arg_min(-balance, date) FILTER (balance < 0), 2) AS first_amount,
    round(max(greatest(0, -balance)), 2) + 0.0 AS peak_gap, round(arg_max(balance, date), 2) AS ending FROM led GROUP BY owner""", lambda s,
        d: cents(ledgers.first_gap(cash(s, d), "owner"), "first_amount", "peak_gap", "ending"))
add(
    "asof_forward_schedule",
    f"""WITH {RET}, p AS (SELECT m::DATE AS date FROM unnest(generate_series(TIMESTAMP '1995-01-31', TIMESTAMP '2001-12-31',
    INTERVAL 7 DAY)) g(m)), u AS (SELECT p.date, (SELECT min(x.date) FROM ret x WHERE x.date >= p.date) AS used FROM p) SELECT date,
    CASE WHEN used - date <= 3 THEN used END AS used FROM u""",
    lambda s, d: ledgers.first_on_or_after(s.range(1).select(F.explode(F.expr("sequence(date'1995-01-31', date'2001-12-31', interval 7 days)")).alias("date")),
        v.ret(s, d).select("date").distinct(), 3),
)
add(
    "xirr",
    """WITH RECURSIVE f0 AS (SELECT o_custkey AS owner, o_orderdate::DATE AS date, -o_totalprice AS amount FROM orders UNION ALL
    SELECT o_custkey, DATE '2002-01-01', 1.1 * sum(o_totalprice) FROM orders GROUP BY 1),
    f AS (SELECT owner, (date - min(date) OVER (PARTITION BY owner)) / 365.25 AS t, sum(amount) AS a FROM f0 GROUP BY owner, date),
    it AS (SELECT owner, 0 AS k, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM (SELECT DISTINCT owner FROM f) UNION ALL
      SELECT it.owner, k + 1, CASE WHEN n.v > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN n.v > 0 THEN hi ELSE (lo + hi) / 2 END
      FROM it, LATERAL (SELECT sum(a * exp(-(it.lo + it.hi) / 2 * t)) AS v FROM f WHERE f.owner = it.owner) n WHERE k < 80)
    SELECT owner, round(100 * (exp((lo + hi) / 2) - 1), 6) + 0.0 AS xirr FROM it WHERE k = 80""",
    lambda s, d: ledgers.xirr(v.invested(s, d), "owner").withColumn("xirr", F.round("xirr", 6)),
)
add(
    "observed_twr",
    """WITH m AS (SELECT o_orderpriority AS owner, date_trunc('month', o_orderdate)::DATE AS date, sum(o_totalprice) AS flow FROM orders
    GROUP BY ALL), b AS (SELECT *, (sum(flow) OVER (PARTITION BY owner ORDER BY date) - flow) * (1 + (month(date) % 7 - 3) / 100) AS before FROM m),
    x AS (SELECT *, before + flow AS after, row_number() OVER (PARTITION BY owner ORDER BY date) AS k, before / lag(before + flow) OVER (PARTITION BY owner ORDER BY date) AS g
    FROM b)
    SELECT owner, round(exp(sum(ln(g))) - 1, 7) + 0.0 AS twr, round(sum(flow) FILTER (k > 1), 2) AS net_flow, round(arg_min(after,
    date), 2) AS opening, round(arg_max(after, date), 2) AS ending, round(arg_max(after, date) - arg_min(after, date) - sum(flow) FILTER (k > 1), 2) + 0.0 AS profit FROM x
    GROUP BY owner""",
    lambda s, d: cents(ledgers.observed(v.valuations(s, d), "owner"), "net_flow", "opening", "ending", "profit"),
)

EXIT = "x0 AS (SELECT o_custkey AS owner, o_orderdate::DATE AS date, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE -o_totalprice END AS amount FROM orders)"


def exits(s: SparkSession, d: str) -> DataFrame:
    o = v.table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 2).otherwise(-F.col("o_totalprice")).alias("amount"))


add(
    "exit_cash",
    f"""WITH RECURSIVE {EXIT}, dd AS (SELECT owner, date, sum(amount) AS a FROM x0 GROUP BY ALL HAVING sum(amount) <> 0), t AS (SELECT *,
    CASE WHEN sign(a) <> lag(sign(a)) OVER (PARTITION BY owner ORDER BY date) THEN 1 ELSE 0 END AS turn, (date - min(date) OVER (PARTITION BY owner)) / 365.25 AS y
    FROM dd), c AS (SELECT owner, sum(turn) AS changes, arg_min(a, date) < 0 AND arg_max(a, date) > 0 AND sum(turn) = 1 AS able FROM t GROUP BY owner),
    f AS MATERIALIZED (SELECT t.owner, y, a FROM t JOIN c ON c.owner = t.owner AND able), it AS (SELECT owner, 0 AS k, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM (SELECT owner
    FROM f GROUP BY owner HAVING sum(a * exp(20 * y)) > 0 AND sum(a * exp(-20 * y)) < 0) UNION ALL
      SELECT it.owner, k + 1, CASE WHEN n.v > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN n.v > 0 THEN hi ELSE (lo + hi) / 2 END
      FROM it, LATERAL (SELECT sum(a * exp(-(it.lo + it.hi) / 2 * y)) AS v FROM f WHERE f.owner = it.owner) n WHERE k < 80)
    SELECT owner, round(sum(-amount) FILTER (amount < 0), 2) AS paid, round(sum(amount) FILTER (amount > 0), 2) AS received, round(sum(amount),
    2) + 0.0 AS net, {r('sum(amount) FILTER (amount > 0) / sum(-amount) FILTER (amount < 0) AS multiple')}, max(changes)::BIGINT AS changes, round(max(x.v), 4) + 0.0 AS xirr
    FROM x0 JOIN c USING (owner) LEFT JOIN (SELECT owner, 100 * (exp((lo + hi) / 2) - 1) AS v FROM it WHERE k = 80) x USING (owner) GROUP BY owner""",
    lambda s, d: cents(ledgers.exit_cash(exits(s, d), "owner"), "paid", "received", "net").withColumn("xirr", F.round("xirr", 4)),
)
SCENARIOS = [("normal", 1.0, "1997-01-01", 0.0, 0), ("stress", 0.6, "1997-04-01", 0.2, 10), ("late", 1.0, "1997-01-01", 0.0, 45)]


def scenario_flows(s: SparkSession, d: str) -> DataFrame:
    """Flows of all orders; what settles after the greatest date isn't cash yet."""
    o = v.table(s, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "income").when(F.col("o_orderstatus") == "O", "sale").otherwise("spending")
    flows = o.select(F.col("o_orderpriority").alias("owner"), F.to_date("o_orderdate").alias("date"), kind.alias("kind"),
        F.when(kind == "spending", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"))
    cases = s.createDataFrame(SCENARIOS, "scenario string, income_multiplier double, change_from string, extra_haircut double, delay_days int").withColumn("change_from", F.to_date("change_from"))
    return ledgers.under_scenarios(flows, cases).join(F.broadcast(span(flows)), F.col("date").between(F.col("least"), F.col("greatest"))).drop("least", "greatest")


add(
    "cash_scenarios",
    """WITH sc(scenario, m, since, h, dl) AS (VALUES ('normal', 1.0, DATE '1997-01-01', 0.0, 0), ('stress', 0.6, DATE '1997-04-01',
    0.2, 10), ('late', 1.0, DATE '1997-01-01', 0.0, 45)),
    f AS (SELECT o_orderpriority AS owner, o_orderdate::DATE AS date, o_orderstatus AS st, o_totalprice AS p FROM orders),
    x AS (SELECT scenario, owner, CASE WHEN st = 'O' THEN date + dl ELSE date END AS date, CASE WHEN st = 'F' THEN p *
    CASE WHEN date >= since THEN m ELSE 1 END WHEN st = 'O' THEN p * (1 - h) ELSE -p END AS a FROM f, sc)
    SELECT scenario, owner, count(*)::BIGINT AS n, round(sum(a), 2) + 0.0 AS amount FROM x WHERE date <= (SELECT max(date) FROM f) GROUP BY ALL""",
    lambda s, d: cents(scenario_flows(s, d).groupBy("scenario", "owner").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount"),
)
add(
    "dca_ledger",
    f"""WITH {RET}, nv AS (SELECT date, nav FROM path WHERE asset = 'A'), pl AS (SELECT m::DATE AS d FROM unnest(generate_series(TIMESTAMP '1995-02-01', TIMESTAMP '2001-06-01',
    INTERVAL 1 MONTH)) g(m)),
    b AS (SELECT used AS date, count(*) AS k FROM (SELECT (SELECT min(date) FROM nv WHERE date >= d) AS used FROM pl) WHERE used IS NOT NULL
    GROUP BY 1), u AS (SELECT nv.date, nav, sum(coalesce(k, 0)) OVER (ORDER BY nv.date) AS ks, sum(coalesce(k, 0) * 100 / 1.015 / nav) OVER (ORDER BY nv.date) AS units FROM nv
    LEFT JOIN b ON b.date = nv.date)
    SELECT date, {r('ks * 100 AS paid', 'units', 'units * nav AS value')} FROM u""",
    lambda s, d: ledgers.scheduled(risk.nav_path(v.ret(s, d).where("asset = 'A'"), "asset").select("date", "nav"),
        s.range(1).select(F.explode(F.expr("sequence(date'1995-02-01', date'2001-06-01', interval 1 month)")).alias("date")), 100.0, 0.015),
)

# Candles
add("candle_metrics", f"""WITH {BARS} SELECT security, at, {r('open', 'high', 'low', 'close')}, volume::BIGINT AS volume, {r('span', 'body', 'upper', 'lower', 'sign', 'body_ratio')} FROM m""", lambda s, d: candles.metrics(v.bars(s, d)))
RULES = f"""{BARS}, l AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(body) OVER w AS b1, lag(body_ratio) OVER w AS r1, lag(sign) OVER w AS s1,
    lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2, lag(body_ratio, 2) OVER w AS r2, lag(sign, 2) OVER w AS s2, lag(close, 1) OVER w / lag(close,
    3) OVER w - 1 AS t1, lag(close, 2) OVER w / lag(close, 4) OVER w - 1 AS t2, lag(close, 3) OVER w / lag(close, 5) OVER w - 1 AS t3 FROM m
    WINDOW w AS (PARTITION BY security ORDER BY at)),
p AS (SELECT security, at, 'doji' AS pattern, 0 AS direction, body_ratio <= 0.1 AS ok, true AS ctx FROM l
UNION ALL SELECT security, at, 'hammer', 1, body_ratio <= 0.3 AND lower >= 2 * body AND upper <= body AND body > 0, t1 < 0 FROM l
UNION ALL SELECT security, at, 'hanging_man', -1, body_ratio <= 0.3 AND lower >= 2 * body AND upper <= body AND body > 0, t1 > 0 FROM l
UNION ALL SELECT security, at, 'inverted_hammer', 1, body_ratio <= 0.3 AND upper >= 2 * body AND lower <= body AND body > 0, t1 < 0 FROM l
UNION ALL SELECT security, at, 'shooting_star', -1, body_ratio <= 0.3 AND upper >= 2 * body AND lower <= body AND body > 0, t1 > 0 FROM l
UNION ALL SELECT security, at, 'bullish_engulfing', 1, s1 < 0 AND sign > 0 AND greatest(open, close) >= greatest(o1, c1) AND least(open, close) <= least(o1, c1)
    AND body > b1, t2 < 0 FROM l
UNION ALL SELECT security, at, 'bearish_engulfing', -1, s1 > 0 AND sign < 0 AND greatest(open, close) >= greatest(o1, c1) AND least(open, close) <= least(o1, c1)
    AND body > b1, t2 > 0 FROM l
UNION ALL SELECT security, at, 'morning_star', 1, s2 < 0 AND r2 >= 0.6 AND r1 <= 0.3 AND greatest(o1, c1) < c2 AND sign > 0 AND close > (o2 + c2) / 2
    AND open > greatest(o1, c1), t3 < 0 FROM l
UNION ALL SELECT security, at, 'evening_star', -1, s2 > 0 AND r2 >= 0.6 AND r1 <= 0.3 AND least(o1, c1) > c2 AND sign < 0 AND close < (o2 + c2) / 2
    AND open < least(o1, c1), t3 > 0 FROM l
UNION ALL SELECT security, at, 'three_white_soldiers', 1, sign = 1 AND s1 = 1 AND s2 = 1 AND body_ratio >= 0.6 AND r1 >= 0.6 AND r2 >= 0.6 AND close > c1 AND c1 > c2, t3 < 0 FROM l
UNION ALL SELECT security, at, 'three_black_crows', -1, sign = -1 AND s1 = -1 AND s2 = -1 AND body_ratio >= 0.6 AND r1 >= 0.6 AND r2 >= 0.6 AND close < c1 AND c1 < c2, t3 > 0
    FROM l),
st AS (SELECT *, coalesce(ok, false) AS matched,
    CASE WHEN NOT coalesce(ok, false) THEN 'not-matched' WHEN ctx IS NULL THEN 'context-unknown' WHEN ctx THEN 'matched' ELSE 'context-not-matched' END AS status FROM p)"""
add("candle_rules", f"WITH {RULES} SELECT security, at, pattern, direction::BIGINT AS direction, matched, ctx AS context, status FROM st", lambda s, d: candles.rules(v.bars(s, d)))
add("candle_signal", f"""WITH {RULES} SELECT security, at, sign(sum(CASE WHEN status = 'matched' THEN direction ELSE 0 END))::BIGINT AS signal FROM st GROUP BY ALL""", lambda s,
    d: candles.signal(candles.rules(v.bars(s, d))))
add(
    "pattern_study",
    f"""WITH {RULES}, y AS (SELECT security, at, horizon, y FROM (SELECT security, at, lead(close, 1) OVER w / close - 1 AS y1, lead(close, 3) OVER w / close - 1 AS y3 FROM bars
    WINDOW w AS (PARTITION BY security ORDER BY at)), LATERAL (VALUES (1, y1), (3, y3)) v(horizon, y) WHERE y IS NOT NULL),
    h AS (SELECT pattern, horizon, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, avg((y > 0)::INT) AS positive,
    avg((sign(y) = sign(direction))::INT) FILTER (direction <> 0) AS aligned, min(y) AS worst, max(y) AS best FROM st JOIN y USING (security, at) WHERE status = 'matched'
    GROUP BY ALL)
    SELECT p.pattern, z.horizon::BIGINT AS horizon, coalesce(n, 0)::BIGINT AS n, {r('mean', 'median', 'positive', 'aligned', 'worst', 'best')} FROM (SELECT DISTINCT pattern
    FROM st) p CROSS JOIN (SELECT unnest([1, 3]) AS horizon) z LEFT JOIN h ON h.pattern = p.pattern AND h.horizon = z.horizon""",
    lambda s, d: candles.study(candles.rules(v.bars(s, d)), v.bars(s, d), [1, 3]),
)
add("geometry_channels", f"""WITH {BARS} SELECT security, at, {r('(close - open) / close AS body', 'upper / close AS upper', 'lower / close AS lower', 'open / lag(close) OVER w - 1 AS gap', 'close / lag(close, 2) OVER w - 1 AS change2')} FROM m WINDOW w AS (PARTITION BY security ORDER BY at)""", lambda s, d: candles.geometry(v.bars(s, d)))
STAGES = [("train", "2024-01-01", "2024-01-15"), ("validation", "2024-01-16", "2024-01-20"), ("test", "2024-01-21", "2024-02-01")]
add(
    "purge_splits",
    f"""WITH {BARS}, x AS (SELECT security, at, at + INTERVAL 30 HOUR AS available, CASE WHEN at BETWEEN '2024-01-01' AND '2024-01-15' THEN 'train' WHEN at BETWEEN '2024-01-16'
    AND '2024-01-20' THEN 'validation' WHEN at BETWEEN '2024-01-21' AND '2024-02-01' THEN 'test' END AS stage FROM bars)
    SELECT security, at, stage, coalesce(available >= CASE stage WHEN 'train' THEN TIMESTAMP '2024-01-15' WHEN 'validation' THEN TIMESTAMP '2024-01-20' END, false) AS purged
    FROM x WHERE stage IS NOT NULL""",
    lambda s, d: candles.purged_splits(v.bars(s, d).select("security", F.col("at").alias("signal_at"), (F.col("at") + F.expr("interval 30 hours")).alias("available_at")), STAGES,
        1).select("security", F.col("signal_at").alias("at"), "stage", "purged"),
)
add("train_scaler", f"""WITH {BARS}, x AS (SELECT unnest(['open', 'close', 'volume']) AS channel, unnest([open, close, volume]) AS v FROM bars)
    SELECT channel, {r('avg(v) AS mean', 'CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS std')} FROM x GROUP BY channel""", lambda s,
        d: candles.scaler(v.bars(s, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v"))
            for c in ("open", "close", "volume")))).alias("x")).select("x.*")))
add("rule_mapping", f"""WITH {RULES}, g AS (SELECT security, at, sign(sum(CASE WHEN status = 'matched' THEN direction ELSE 0 END))::INT AS signal FROM st
    GROUP BY ALL), y AS (SELECT security, at, lead(close) OVER (PARTITION BY security ORDER BY at) / close - 1 AS y FROM bars), j AS (SELECT signal, y FROM g
    JOIN y USING (security, at) WHERE y IS NOT NULL) SELECT s.signal::BIGINT AS signal, {r('coalesce(avg(j.y), (SELECT avg(y) FROM j)) AS y')}
    FROM (SELECT unnest([-1, 0, 1]) AS signal) s LEFT JOIN j USING (signal) GROUP BY s.signal""", lambda s, d: candles.rule_mapping(labelled_signals(s, d)))


def labelled_signals(s: SparkSession, d: str) -> DataFrame:
    bars = v.bars(s, d)
    return candles.signal(candles.rules(bars)).join(bars.select("security", "at", (F.lead("close").over(candles.own()) / F.col("close") - 1).alias("y")).where("y is not null"),
        ["security", "at"]).select("signal", "y")
