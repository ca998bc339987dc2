"""Queries of exposure and dated cash needs, over customers and orders taken as accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand, exposure
from . import views as v
from .catalog import GRAPH
from .registry import add, r

START, END = dt.date(1994, 12, 31), dt.date(2002, 12, 31)


# Exposure: an account of region funds, customers' balances as direct lots, a fund without disclosure and a position of unknown kind.
def account(s: SparkSession, d: str) -> DataFrame:
    funds = v.table(s, d, "region").select(F.concat(F.lit("F"), "r_name").alias("position_id"), F.lit("fund").alias("kind"), (1000.0 * (F.col("r_regionkey") + 1)).alias("amount"),
        F.lit(0.0).alias("frozen_amount"), F.col("r_name").alias("node"), F.lit(None).cast("string").alias("security"))
    odd = s.createDataFrame([("Fnone", "fund", 500.0, 0.0, "NOWHERE", None), ("U", "unknown", 250.0, 0.0, None, None)],
        "position_id string, kind string, amount double, frozen_amount double, node string, security string")
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "MACHINERY", "bond").when(seg == "FURNITURE", "cash").otherwise("stock")
    lots = v.table(s, d, "customer").where("c_acctbal > 0").withColumn("kind", kind)
    lots = lots.select(F.concat(F.lit("P"), "c_custkey").alias("position_id"), "kind", F.col("c_acctbal").alias("amount"),
        F.when(F.col("kind") == "cash", 0.1 * F.col("c_acctbal")).otherwise(0.0).alias("frozen_amount"), F.lit(None).cast("string").alias("node"), F.concat(F.lit("D"), "c_name").alias("security"))
    return funds.unionByName(odd).unionByName(lots).withColumn("economic_lot_id", F.concat(F.lit("L"), "position_id"))


def master(s: SparkSession, d: str) -> DataFrame:
    """Three of four customers are known as stocks, two of three direct lots under their own kind."""
    c = v.table(s, d, "customer").join(F.broadcast(v.table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "MACHINERY", "bond").when(seg == "FURNITURE", "cash").otherwise("stock")
    issuer = F.when(k % 7 != 0, F.col("n_name"))
    industry = F.when(k % 5 != 0, seg)
    stocks = c.where(k % 4 != 0).select(F.col("c_name").alias("security"), F.lit("stock").alias("kind"), issuer.alias("issuer"), industry.alias("industry"),
        F.lit(None).cast("double").alias("duration"), F.when(k % 9 != 0, "list").otherwise(" ").alias("source"))
    own = c.where(k % 3 != 0).select(F.concat(F.lit("D"), "c_name").alias("security"), kind.alias("kind"), issuer.alias("issuer"), industry.alias("industry"),
        F.when(k % 2 == 0, (k % 10).cast("double")).alias("duration"), F.lit("list").alias("source"))
    return stocks.unionByName(own)


KIND = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'bond' WHEN 'FURNITURE' THEN 'cash' ELSE 'stock' END"
EXPOSED = f"""{GRAPH.split(',\nwalk AS')[0]},
mst AS (SELECT c_name AS security, 'stock' AS kind, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS issuer, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS industry,
    NULL::DOUBLE AS duration FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0 AND c_custkey % 9 <> 0
    UNION ALL SELECT 'D' || c_name, {KIND}, CASE WHEN c_custkey % 7 <> 0 THEN n_name END, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END,
    CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 10)::DOUBLE END FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0),
fnd AS (SELECT 'F' || r_name AS position_id, r_name AS node, 1000.0 * (r_regionkey + 1) AS amount FROM region),
lvl AS (SELECT position_id, e2.child AS security, 'stock' AS kind, amount * e1.weight * e2.weight AS amount, NULL AS reason FROM fnd JOIN edges e1 ON e1.node = fnd.node
    JOIN edges e2 ON e2.node = e1.child
    UNION ALL SELECT position_id, NULL, 'unknown', amount * (1 - (SELECT sum(weight) FROM edges e WHERE e.node = fnd.node)), 'undisclosed' FROM fnd
    UNION ALL SELECT position_id, NULL, 'unknown', amount * e1.weight * (1 - (SELECT sum(weight) FROM edges e WHERE e.node = e1.child)), 'undisclosed' FROM fnd
    JOIN edges e1 ON e1.node = fnd.node),
rws AS (SELECT *, 'fund_disclosure' AS origin FROM lvl UNION ALL SELECT 'Fnone', NULL, 'unknown', 500, 'missing_fund_disclosure', 'fund_disclosure' UNION ALL
    SELECT 'U', NULL, 'unknown', 250, 'root_classification_unknown', 'direct_account'
    UNION ALL SELECT 'P' || c_custkey, 'D' || c_name, {KIND}, c_acctbal, NULL, 'direct_account' FROM customer WHERE c_acctbal > 0),
told AS (SELECT rws.position_id, rws.security, rws.kind, rws.amount, rws.origin, coalesce(rws.reason,
    CASE WHEN mst.kind IS NULL THEN 'missing_security_identity_or_kind_evidence' END) AS reason, issuer, industry, duration FROM rws LEFT
    JOIN mst ON mst.security = rws.security)"""


def exposed(s: SparkSession, d: str):
    return exposure.account_exposure(account(s, d), v.graph(s, d), master(s, d))


add("account_exposure", f"""WITH {EXPOSED} SELECT position_id, security, kind, origin, issuer, industry, {r('amount')}, {r('duration')} FROM told WHERE reason IS NULL""", lambda s,
    d: exposed(s, d)[0])
add("account_unknown", f"""WITH {EXPOSED} SELECT position_id, reason, count(*)::BIGINT AS n, {r('sum(amount) AS amount')} FROM told WHERE reason IS NOT NULL GROUP BY ALL""", lambda s,
    d: exposed(s, d)[1].groupBy("position_id", "reason").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")))
add(
    "account_cash",
    f"""WITH {EXPOSED} SELECT {r('(SELECT sum(0.9 * amount) FROM rws WHERE kind = $$cash$$) AS available', '(SELECT sum(0.1 * amount) FROM rws WHERE kind = $$cash$$) AS frozen', '0 AS fund_cash')}""",
    lambda s, d: exposed(s, d)[2],
)
add("root_kinds", f"""WITH k AS (SELECT 'fund' AS key, 1000.0 * (r_regionkey + 1) AS amount FROM region UNION ALL SELECT 'fund', 500 UNION ALL SELECT 'unknown', 250 UNION ALL
    SELECT {KIND}, c_acctbal FROM customer WHERE c_acctbal > 0) SELECT 'root_kind' AS level, key, {r('sum(amount) AS amount')} FROM k GROUP BY key""", lambda s, d: exposure.root_kinds(account(s, d)))
add(
    "issuer_mapping",
    f"""WITH RECURSIVE {GRAPH}, m AS (SELECT c_name, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 9 <> 0 THEN n_name END AS issuer FROM customer
    JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0)
    SELECT 'world' AS root, issuer, {r('sum(w) AS w')} FROM walk LEFT JOIN m ON m.c_name = walk.node WHERE kind = 'stock' GROUP BY issuer""",
    lambda s, d: exposure.issuers(exposure.paths(v.graph(s, d), s.createDataFrame([("world",)], "root string")), master(s, d)),
)
add("duplicate_lots", """SELECT l_partkey AS part, l_suppkey AS supplier, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""", lambda s,
    d: v.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n")).where("n > 1"))


def adapted(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "customer").where("c_acctbal > 0").join(F.broadcast(v.table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.col("c_acctbal") / F.sum("c_acctbal").over(v.Window.partitionBy("n_name"))
    rows = c.select(F.col("n_name").alias("node"), F.lit("stock").alias("kind"), F.concat(F.lit("S"), (F.col("c_custkey") % 40)).alias("ident"), part.alias("weight"))
    known = s.range(40).where("id % 6 <> 0").select(F.concat(F.lit("S"), "id").alias("ident"), F.concat(F.lit("sec"), "id").alias("security"))
    return exposure.fund_input(rows, known, v.table(s, d, "nation").select(F.col("n_name").alias("node"), F.lit(0.04).alias("weight")))


add(
    "fund_input",
    f"""WITH c AS (SELECT n_name AS node, 'S' || (c_custkey % 40) AS ident, c_custkey % 40 AS k, c_acctbal / sum(c_acctbal) OVER (PARTITION BY n_name) AS weight FROM customer
    JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)
    SELECT node, CASE WHEN k % 6 = 0 THEN 'unmapped:' || ident ELSE 'sec' || k END AS child, CASE WHEN k % 6 = 0 THEN 'unknown' ELSE 'stock' END AS kind,
    {r('sum(weight) AS weight')} FROM c GROUP BY ALL UNION ALL SELECT 'account', n_name, 'fund', 0.04 FROM nation""",
    adapted,
)
MEMBERS = """mem AS (SELECT c_mktsegment AS grp, c_custkey AS security, CASE WHEN c_mktsegment <> 'FURNITURE' OR c_custkey % 97 <> 5 THEN round(c_acctbal) END AS value
    FROM customer), tgt AS (SELECT DISTINCT c_mktsegment AS grp, round(c_acctbal) AS target FROM customer WHERE c_custkey % 3 = 0)"""


def ranked(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "customer")
    members = c.select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("security"))
    values = c.where("c_mktsegment <> 'FURNITURE' OR c_custkey % 97 <> 5").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("security"), F.round("c_acctbal").alias("value"))
    targets = c.where("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("grp"), F.round("c_acctbal").alias("target")).distinct()
    return exposure.percentile_in(targets, members, values, "grp")


add(
    "universe_percentile",
    f"""WITH {MEMBERS}, w AS (SELECT grp, count(*) AS n, count(value) = count(*) AS complete FROM mem GROUP BY grp)
    SELECT tgt.grp, {r('target')}, {r('CASE WHEN any_value(complete) THEN 100.0 * (count(CASE WHEN value < target THEN 1 END) + 0.5 * count(CASE WHEN value = target THEN 1 END)) / any_value(w.n) END AS percentile')} FROM tgt JOIN mem ON mem.grp = tgt.grp JOIN w ON w.grp = tgt.grp GROUP BY tgt.grp, target""",
    ranked,
)


# Dated cash: nations as accounts; orders are income, line items expenses, some balances are frozen, some positions are for sale.
#: Amounts times this have no half cents, which both engines round in their own way.
UNEVEN = 1.00012345678


def cash_inputs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    c = v.table(s, d, "customer")
    nation = c.groupBy(F.col("c_nationkey").alias("account")).agg((UNEVEN * F.sum(F.abs("c_acctbal"))).alias("b"))
    cash = nation.select("account", F.lit("cash").alias("position_id"), F.lit("cash").alias("kind"), F.col("b").alias("amount"), (F.col("b") / 2).alias("frozen_amount"))
    suppliers = v.table(s, d, "supplier").select(F.col("s_nationkey").alias("account"), F.concat(F.lit("s"), "s_suppkey").alias("position_id"), F.lit("stock").alias("kind"),
        (UNEVEN * F.abs("s_acctbal")).alias("amount"), F.lit(0.0).alias("frozen_amount"))
    owners = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("account"))
    o = v.table(s, d, "orders").join(owners, "o_custkey")
    k = F.col("o_orderkey")
    flows = o.select("account", F.concat(F.lit("o"), k).alias("id"), F.when(k % 2 == 0, "income").otherwise("necessary_expense").alias("kind"),
        F.when((F.col("account") != 3) | (k % 50 != 0), F.to_date("o_orderdate")).alias("date"), F.col("o_totalprice").alias("amount"))
    releases = nation.select("account", F.concat(F.lit("r"), "account").alias("id"), F.lit("cash").alias("position_id"), (F.col("b") / 4).alias("amount"),
        F.lit(dt.date(1996, 3, 1)).alias("date"), F.when(F.col("account") % 3 != 0, F.col("account") % 3 == 1).alias("condition_met"))
    q = F.col("s_suppkey")
    sup = v.table(s, d, "supplier").withColumn("account", F.col("s_nationkey"))
    sales = sup.where(q % 4 == 0).select("account", F.concat(F.lit("x"), q).alias("id"), F.concat(F.lit("s"), q).alias("position_id"), (UNEVEN * F.abs("s_acctbal") / 2).alias("book_amount"),
        F.date_add(F.lit(dt.date(1996, 1, 1)), (q % 300).cast("int")).alias("trade_date"))
    liquidity = sup.where(q % 5 != 4).select(
        "account",
        F.concat(F.lit("s"), q).alias("position_id"),
        (q % 7 != 0).alias("can_sell"),
        F.lit(0.1).alias("haircut"),
        F.when(q % 11 != 0, F.lit(0.01)).alias("fee_rate"),
        F.lit("deduct_from_settlement_proceeds").alias("fee_timing"),
        (q % 5).cast("int").alias("settlement_days"),
        F.lit("calendar").alias("settlement_day_basis"),
        F.lit(dt.date(1995, 6, 1)).alias("earliest_sale_date"),
        F.lit("terms").alias("source"),
    )
    scenarios = s.createDataFrame([("normal", 1.0, None, 0.0, 0, True), ("stress", 0.6, dt.date(1997, 1, 1), 0.2, 2400, True), ("no_release", 1.0, None, 0.0, 5, False)],
        "scenario string, income_multiplier double, income_change_from date, additional_haircut double, settlement_delay_days int, freeze_release_enabled boolean")
    return {"positions": cash.unionByName(suppliers), "flows": flows, "releases": releases, "sales": sales, "liquidity": liquidity, "scenarios": scenarios}


DEMAND = """sc(scenario, m, since, extra, delay, rel) AS (VALUES ('normal', 1.0, DATE '0001-01-01', 0.0, 0, true), ('stress', 0.6, DATE '1997-01-01',
    0.2, 2400, true), ('no_release', 1.0, DATE '0001-01-01', 0.0, 5, false)),
nat AS (SELECT c_nationkey AS account, 1.00012345678 * sum(abs(c_acctbal)) AS b FROM customer GROUP BY 1),
ev AS (
    SELECT scenario, c_nationkey AS account, 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'income' ELSE 'expense' END AS kind,
    CASE WHEN c_nationkey <> 3 OR o_orderkey % 50 <> 0 THEN o_orderdate::DATE END AS date, o_totalprice * CASE WHEN o_orderkey % 2 = 0
    AND (CASE WHEN c_nationkey <> 3 OR o_orderkey % 50 <> 0 THEN o_orderdate::DATE END) >= since THEN m ELSE 1 END AS amount,
        CASE WHEN c_nationkey = 3 AND o_orderkey % 50 = 0 THEN 'unknown' ELSE 'resolved' END AS status, CASE WHEN c_nationkey = 3
        AND o_orderkey % 50 = 0 THEN 'unknown_cashflow_amount_or_date' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey, sc
    UNION ALL SELECT scenario, account, 'r' || account, 'release', DATE '1996-03-01', b / 4,
    CASE WHEN NOT rel OR account % 3 = 2 THEN 'blocked' WHEN account % 3 = 0 THEN 'unknown' ELSE 'resolved' END,
    CASE WHEN NOT rel OR account % 3 = 2 THEN 'release_disabled_or_condition_false' WHEN account % 3 = 0 THEN 'unknown_release_condition_or_date' END FROM nat, sc
    UNION ALL SELECT scenario, account, id, 'sale_net', CASE WHEN ok THEN arrival END, CASE WHEN ok THEN net END,
    CASE WHEN blocked THEN 'blocked' WHEN NOT ok THEN 'unknown' WHEN arrival > DATE '2002-12-31' THEN 'after_horizon' ELSE 'resolved' END,
    CASE WHEN blocked THEN 'explicitly_not_sellable' WHEN NOT ok
    AND k % 5 = 4 THEN 'unknown_liquidity:can_sell,haircut,fee_rate,settlement_days,earliest_sale_date,source,settlement_day_basis,fee_timing' WHEN NOT ok THEN 'unknown_liquidity:fee_rate' WHEN arrival > DATE '2002-12-31' THEN 'not_available_within_horizon' END
    FROM (SELECT scenario, s_nationkey AS account, 'x' || s_suppkey AS id, s_suppkey AS k, s_suppkey % 5 <> 4 AND s_suppkey % 7 = 0 AS blocked, s_suppkey % 5 <> 4
    AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AS ok, DATE '1996-01-01' + (s_suppkey % 300)::INT + (s_suppkey % 5)::INT + delay AS arrival,
    1.00012345678 * abs(s_acctbal) / 2 * (1 - least(1, 0.1 + extra)) * 0.99 AS net FROM supplier, sc WHERE s_suppkey % 4 = 0)),
dy AS (SELECT scenario, account, date, sum(CASE WHEN kind = 'income' THEN amount ELSE 0 END) AS i, sum(CASE WHEN kind = 'expense' THEN amount ELSE 0 END) AS e,
    sum(CASE WHEN kind = 'release' THEN amount ELSE 0 END) AS l, sum(CASE WHEN kind = 'sale_net' THEN amount ELSE 0 END) AS x FROM ev WHERE status = 'resolved' GROUP BY ALL),
cal AS (SELECT account, scenario, b, d::DATE AS date FROM nat, sc, range(DATE '1994-12-31', DATE '2003-01-01', INTERVAL 1 DAY) t(d)),
led AS (SELECT cal.scenario, cal.account, cal.date, coalesce(i, 0) AS income, coalesce(e, 0) AS expense, coalesce(l, 0) AS release,
    coalesce(x, 0) AS sale_net, b / 2 + sum(coalesce(i, 0) + coalesce(l, 0) - coalesce(e, 0) + coalesce(x, 0)) OVER w AS balance, b / 2 - sum(coalesce(l,
    0)) OVER w AS frozen, b / 2 + sum(coalesce(i, 0) + coalesce(l, 0) - coalesce(e, 0)) OVER w AS without_sales
    FROM cal LEFT JOIN dy ON dy.scenario = cal.scenario AND dy.account = cal.account AND dy.date = cal.date WINDOW w AS (PARTITION BY cal.scenario, cal.account ORDER BY cal.date)),
mk AS (SELECT scenario, account, sum((status = 'unknown')::INT) AS unknowns, sum((status = 'blocked')::INT) AS blocked FROM ev GROUP BY ALL),
su AS (SELECT led.scenario, led.account, min(CASE WHEN balance < 0 THEN date END) AS first_gap, arg_min(-balance, date) FILTER (balance < 0) AS first_amount,
    max(greatest(0, -balance)) AS peak, greatest(0, max(-without_sales)) AS no_sale_peak, arg_max(balance, date) AS ending, arg_max(frozen, date) AS ending_frozen FROM led
    GROUP BY ALL)"""


def _cents(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 2) + F.lit(0.0) for n in names})


def c(*names: str) -> str:
    return ", ".join(f"round(({e})::DOUBLE, 2) + 0.0 AS {n}" for e, n in (x.rsplit(" AS ", 1) if " AS " in x else (x, x) for x in names))


def demanded(s: SparkSession, d: str):
    return demand.cash_demand(**cash_inputs(s, d), start=START, end=END)


add("demand_events", f"""WITH {DEMAND} SELECT scenario, account::BIGINT AS account, kind, status, reason, count(*)::BIGINT AS n, {c('sum(amount) AS amount')} FROM ev GROUP BY ALL""",
    lambda s, d: _cents(demanded(s, d)[0].groupBy("scenario", "account", "kind", "status", "reason").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount"))
add("demand_ledger", f"""WITH {DEMAND} SELECT scenario, account::BIGINT AS account,
    date, {c('income', 'expense', 'release', 'sale_net', 'balance', 'frozen', 'without_sales', 'greatest(0, -balance) AS gap')} FROM led""", lambda s,
        d: _cents(demanded(s, d)[1], "income", "expense", "release", "sale_net", "balance", "frozen", "without_sales", "gap"))
add(
    "cash_demand",
    f"""WITH {DEMAND} SELECT su.scenario, su.account::BIGINT AS account,
    first_gap, {c('first_amount', 'peak', 'no_sale_peak', 'ending', 'ending_frozen', 'CASE WHEN unknowns = 0 THEN ending END AS complete_balance')},
    unknowns::BIGINT AS unknowns, blocked::BIGINT AS blocked, CASE WHEN unknowns = 0 THEN 'conditional_on_declared_inputs' ELSE 'conditional_with_unknowns' END AS status FROM su
    JOIN mk ON mk.scenario = su.scenario AND mk.account = su.account""",
    lambda s, d: _cents(demanded(s, d)[2], "first_amount", "peak", "no_sale_peak", "ending", "ending_frozen", "complete_balance"),
)


def liquidated(s: SparkSession, d: str) -> DataFrame:
    i = cash_inputs(s, d)
    found = demanded(s, d)[2]
    return _cents(demand.liquidation(i["positions"], i["sales"], i["liquidity"], i["scenarios"], found), "net_value", "remaining", "needed").drop("reason")


add(
    "liquidation_comparison",
    f"""WITH {DEMAND}, a AS (SELECT sc.scenario, s_nationkey AS account, 's' || s_suppkey AS position_id, s_suppkey % 5 <> 4 AND s_suppkey % 7 <> 0
    AND s_suppkey % 11 <> 0 AS ok, 1.00012345678 * abs(s_acctbal) AS book, 1.00012345678 * (abs(s_acctbal) -
    CASE WHEN s_suppkey % 4 = 0 THEN abs(s_acctbal) / 2 ELSE 0 END) AS remaining,
    (1 - least(1, 0.1 + extra)) * 0.99 AS f, DATE '1995-06-01' + (s_suppkey % 5)::INT + delay AS receipt FROM supplier, sc)
    SELECT a.scenario, a.account::BIGINT AS account, position_id,
    {c('CASE WHEN ok THEN book * f END AS net_value', 'remaining', 'CASE WHEN ok AND peak > 0 AND receipt <= first_gap THEN peak / f END AS needed')},
    CASE WHEN ok THEN receipt END AS receipt, CASE WHEN ok THEN receipt <= first_gap END AS in_time, CASE WHEN ok AND peak > 0
    AND receipt <= first_gap THEN peak / f <= remaining END AS sufficient FROM a JOIN su ON su.scenario = a.scenario AND su.account = a.account""",
    liquidated,
)


def fitted(s: SparkSession, d: str) -> DataFrame:
    """Each account plans to pay 30,000 on the first of July 1996; every fourth may not be able to trade."""
    i = cash_inputs(s, d)
    plans = i["positions"].select("account").distinct().select("account", F.concat(F.lit("factor:"), "account").alias("id"), F.when(F.col("account") % 4 != 0, F.lit(True)).alias("can_trade"))
    extra = plans.select("account", "id", F.lit("necessary_expense").alias("kind"), F.lit(dt.date(1996, 7, 1)).alias("date"), F.lit(30000.0).alias("amount"))
    after = demand.cash_demand(**(i | {"flows": i["flows"].unionByName(extra)}), start=START, end=END)[2]
    return _cents(demand.cash_fit(demanded(s, d)[2], after, plans), "conflict", "added")


add(
    "cash_fit",
    f"""WITH {DEMAND}, af AS (SELECT scenario, account, max(greatest(0, -(balance - CASE WHEN date >= DATE '1996-07-01' THEN 30000 ELSE 0 END))) AS peak2 FROM led GROUP BY ALL)
    SELECT su.scenario, su.account::BIGINT AS account, CASE WHEN unknowns = 0 AND su.account % 4 <> 0 THEN 'conditional_on_declared_inputs' ELSE 'unknown' END AS status,
    {c('CASE WHEN unknowns = 0 AND su.account % 4 <> 0 THEN peak2 END AS conflict', 'CASE WHEN unknowns = 0 AND su.account % 4 <> 0 THEN greatest(0, peak2 - peak) END AS added')}
    FROM su JOIN mk ON mk.scenario = su.scenario AND mk.account = su.account JOIN af ON af.scenario = su.scenario AND af.account = su.account""",
    fitted,
)


def periods(s: SparkSession, d: str) -> DataFrame:
    o = v.table(s, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("start")).agg(F.count("*").alias("n"))
    later = F.lead("start").over(v.Window.partitionBy("o_custkey").orderBy("start"))
    return o.select(F.col("o_custkey").alias("owner"), "start", F.when(F.col("n") == 1, F.coalesce(later, F.col("start"))).otherwise(F.date_add("start", 1)).alias("end"))


add(
    "consecutive_periods",
    """WITH p AS (SELECT o_custkey AS owner, o_orderdate::DATE AS start, count(*) AS n FROM orders GROUP BY ALL), q AS (SELECT owner, start,
    CASE WHEN n = 1 THEN coalesce(lead(start) OVER (PARTITION BY owner ORDER BY start), start) ELSE start + 1 END AS e FROM p)
    SELECT owner, start, e AS "end", coalesce(start = lag(e) OVER (PARTITION BY owner ORDER BY start), true) AS follows FROM q""",
    lambda s, d: demand.consecutive(periods(s, d), "owner"),
)
