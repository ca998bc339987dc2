"""Queries of ledgers, evaluation, budgets, migration and the network, over the daily returns of the three return flags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest, budget, evaluation, evidence, ledgers, migration, network, risk, solve
from . import views as v
from .catalog import EQUAL, RET, daily_path
from .registry import add, r

COST = 0.001

#: A ledger as a recursive query, a step for each date, for paths with rules of their own (share of costs, quarterly, threshold, orders, whether positive flows are invested). What is left
#: after costs is a fixed point that eight rounds reach, as each is closer by the share of costs.
WIDE = f"""{RET}, w0 AS (SELECT date, max(CASE asset WHEN 'A' THEN r END) AS a, max(CASE asset WHEN 'N' THEN r END) AS n, max(CASE asset WHEN 'R' THEN r END) AS f FROM ret GROUP BY date),
w1 AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS k, coalesce(date_trunc('quarter', date) <> lag(date_trunc('quarter',
    date)) OVER (ORDER BY date), true) AS q, coalesce(year(date) <> lag(year(date)) OVER (ORDER BY date), false) AS y FROM w0)"""


def recursion(paths: str, flow: str = "0.0", target: str = "0.3", extra: str = "false") -> str:
    """``paths`` has rows (path, c, quarterly, thr, orders, invest); ``flow`` and ``extra``, another reason to trade, are expressions over w1."""
    t = target
    net = "total"
    layers = ""
    inner = "s4"
    for i in range(8):
        prev = "total" if i == 0 else f"n{i}"
        layers = f"""SELECT *, total - c * (abs({t} * {prev} - ha) + abs({t} * {prev} - hn) + abs({t} * {prev} - hf)) AS n{i + 1} FROM ({layers or f'SELECT * FROM ({inner}) s4'}) l{i}"""
        net = f"n{i + 1}"
    s1 = f"""SELECT p.*, w.k AS kk, w.date AS d, w.a, w.n, w.f, w.q, w.y, {flow} AS flow_, l.ha, l.hn, l.hf, l.cash + ({flow}) AS cash,
    l.ha + l.hn + l.hf + l.cash AS before, l.nav, {extra} AS extra FROM led l JOIN cfg p ON p.path = l.path JOIN w1 w ON w.k = l.k + 1"""
    s2 = f"SELECT *, CASE WHEN cash < 0 THEN -cash / ((ha + hn + hf) * (1 - c)) ELSE 0 END AS part FROM ({s1}) s1"
    s3 = f"""SELECT * REPLACE (ha * (1 - part) AS ha, hn * (1 - part) AS hn, hf * (1 - part) AS hf, CASE WHEN cash < 0 THEN 0 ELSE cash END AS cash), part * (ha + hn + hf) AS sold
    FROM ({s2}) s2"""
    s4 = f"SELECT *, ha + hn + hf + cash AS total FROM ({s3}) s3"
    layers = layers.replace("(s4) s4", f"({s4}) s4")
    due = f"(kk = 0 OR (quarterly AND q) OR extra OR (invest AND flow_ > 0) OR (thr IS NOT NULL AND greatest(abs(ha / total - {t}), abs(hn / total - {t}), abs(hf / total - {t})) / {t} > thr)) AND (NOT orders OR kk = 0)"
    s5 = f"SELECT *, {due} AS due FROM ({layers}) s5"
    s6 = f"""SELECT * REPLACE (CASE WHEN due THEN {t} * {net} ELSE ha END AS ha, CASE WHEN due THEN {t} * {net} ELSE hn END AS hn, CASE WHEN due THEN {t} * {net} ELSE hf END AS hf,
    CASE WHEN due THEN {net} * (1 - 3 * {t}) ELSE cash END AS cash), sold +
    CASE WHEN due THEN abs({t} * {net} - ha) + abs({t} * {net} - hn) + abs({t} * {net} - hf) ELSE 0 END AS turn FROM ({s5}) s6"""
    s7 = f"""SELECT * REPLACE (ha - CASE WHEN orders AND y THEN 2.0 ELSE 0 END AS ha, hn + CASE WHEN orders AND y THEN 1.0 ELSE 0 END AS hn, cash + CASE WHEN orders
    AND y THEN 1.0 - 3.0 * c ELSE 0 END AS cash, turn + CASE WHEN orders AND y THEN 3.0 ELSE 0 END AS turn) FROM ({s6}) s7"""
    return f"""{WIDE}, cfg(path, c, quarterly, thr, orders, invest) AS (VALUES {paths}),
    led AS (SELECT path, -1::BIGINT AS k, NULL::DATE AS date, 0.0::DOUBLE AS ha, 0.0::DOUBLE AS hn, 0.0::DOUBLE AS hf, 100.0::DOUBLE AS cash,
    1.0::DOUBLE AS nav, 0.0::DOUBLE AS flow, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS r, 100.0::DOUBLE AS value FROM cfg
    UNION ALL SELECT path, kk, d, ha * (1 + a), hn * (1 + n), hf * (1 + f), cash, nav * (ha * (1 + a) + hn * (1 + n) + hf * (1 + f) + cash) / (before + flow_),
    flow_::DOUBLE, c * turn, turn, (ha * (1 + a) + hn * (1 + n) + hf * (1 + f) + cash) / (before + flow_) - 1, ha * (1 + a) + hn * (1 + n) + hf * (1 + f) + cash FROM ({s7}) s8)"""


LEDGER = r("value", "cash", "flow", "cost", "turnover", "r", "nav")


def path_sql(paths: str, **more: str) -> str:
    return f"WITH RECURSIVE {recursion(paths, **more)} SELECT path, date, {LEDGER} FROM led WHERE k >= 0"


add(
    "backtest_quarterly",
    path_sql("('demo', 0.001, true, NULL::DOUBLE, false, true)"),
    lambda s, d: backtest.backtest(daily_path(s, d), EQUAL, rate=0.001, rebalance="quarterly"),
)
add(
    "backtest_threshold",
    path_sql("('demo', 0.001, false, 0.1, false, true)"),
    lambda s, d: backtest.backtest(daily_path(s, d), EQUAL, rate=0.001, threshold=0.1),
)


def quarter_flows(s: SparkSession, d: str) -> DataFrame:
    """1.5 is taken out on the first date of each quarter but the first, 4 paid in instead in July."""
    dates = v.ret(s, d).select("date").distinct()
    first = dates.groupBy(F.trunc("date", "quarter").alias("q")).agg(F.min("date").alias("date"))
    return first.where(F.col("q") > F.lit(first.agg(F.min("q")).first()[0])).select("date", F.when(F.month("date") == 7, 4.0).otherwise(-1.5).alias("amount"))


FLOW = "CASE WHEN NOT w.q OR w.k = 0 THEN 0.0 WHEN month(w.date) = 7 THEN 4.0 ELSE -1.5 END"
add("withdrawal_ledger", path_sql("('demo', 0.001, false, NULL::DOUBLE, false, true)", flow=FLOW), lambda s, d: backtest.backtest(daily_path(s, d), EQUAL, rate=COST, flows=quarter_flows(s, d)))
add("flows_stay_in_cash", path_sql("('demo', 0.001, true, NULL::DOUBLE, false, false)", flow=FLOW), lambda s,
    d: backtest.backtest(daily_path(s, d), EQUAL, rate=COST, rebalance="quarterly", flow_rule="cash", flows=quarter_flows(s, d)))


def year_orders(s: SparkSession, d: str) -> DataFrame:
    """On the first date of each year but the first 2 of A are sold and 1 of N is bought."""
    dates = v.ret(s, d).select("date").distinct()
    first = dates.groupBy(F.year("date").alias("y")).agg(F.min("date").alias("date"))
    first = first.where(F.col("y") > F.lit(first.agg(F.min("y")).first()[0]))
    return first.select("date", F.explode(F.array(F.struct(F.lit("A").alias("asset"), F.lit(-2.0).alias("notional")),
        F.struct(F.lit("N").alias("asset"), F.lit(1.0).alias("notional")))).alias("o")).select("date", "o.*")


ABC = "('A_actual', 0.001, false, NULL::DOUBLE, true, true), ('B_hold', 0.001, false, NULL, false, false), ('C_mechanical', 0.001, true, NULL, false, true), ('gross_actual', 0.0, false, NULL, true, true), ('gross_hold', 0.0, false, NULL, false, false)"


def abc(s: SparkSession, d: str):
    return backtest.counterfactual(v.ret(s, d), backtest.Rules(EQUAL, rates=COST), year_orders(s, d))


add("counterfactual_ledgers", path_sql(ABC), lambda s, d: abc(s, d)[0].drop("weights", "trades"))
add(
    "counterfactual_abc",
    f"""WITH RECURSIVE {recursion(ABC)}, e AS (SELECT path, arg_max(value, k) AS value FROM led WHERE k >= 0
    GROUP BY path), x AS (SELECT max(CASE path WHEN 'A_actual' THEN value END) AS a,
    max(CASE path WHEN 'B_hold' THEN value END) AS b, max(CASE path WHEN 'C_mechanical' THEN value END) AS c,
    max(CASE path WHEN 'gross_actual' THEN value END) AS ga, max(CASE path WHEN 'gross_hold' THEN value END) AS gb FROM e)
    SELECT {r('a - b AS a_minus_b', 'a - c AS a_minus_c', 'c - b AS c_minus_b', 'ga - gb AS gross', 'a - b AS net', '(ga - gb) - (a - b) AS drag')} FROM x""",
    lambda s, d: abc(s, d)[1],
)


def traded(s: SparkSession, d: str) -> DataFrame:
    ledger = backtest.ledgers(daily_path(s, d), backtest.Rules(EQUAL, rates=COST, orders=True), orders=year_orders(s, d))
    return backtest.transactions(ledger, list(EQUAL)).where("reason = 'order'").select("path", "date", "reason", "asset", "notional", "cost")


add("transactions", f"""WITH {WIDE} SELECT 'demo' AS path, date, 'order' AS reason, asset, {r('notional', '0.003 AS cost')} FROM w1, (VALUES ('A', -2.0), ('N', 1.0)) o(asset, notional) WHERE y""", traded)


def schedule(s: SparkSession, d: str) -> DataFrame:
    """Equal weights again on the first date of every even year, by a schedule."""
    dates = v.ret(s, d).select("date").distinct()
    first = dates.groupBy(F.year("date").alias("y")).agg(F.min("date").alias("date")).where("y % 2 = 0")
    return first.select("date", F.explode(F.array(*map(F.lit, EQUAL))).alias("asset"), F.lit(0.3).alias("w"))


add(
    "target_schedule",
    path_sql("('demo', 0.001, false, NULL::DOUBLE, false, true)", extra="(year(w.date) % 2 = 0 AND (w.y OR w.k = 0))"),
    lambda s, d: backtest.ledgers(daily_path(s, d), backtest.Rules(EQUAL, rates=COST), schedule=schedule(s, d)).drop("weights", "trades"),
)

# Rates of return with several roots: what is paid in, taken out, and paid in again.
TURNS = """fl AS (SELECT o_custkey AS owner, o_orderdate::DATE AS date, sum(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END) AS amount FROM orders
    GROUP BY ALL), tt AS (SELECT owner, (date - min(date) OVER (PARTITION BY owner)) / 365.25 AS t, amount FROM fl)"""


def turning(s: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(-1)
    return v.table(s, d, "orders").select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") * sign).alias("amount"))


add(
    "xirr_multi_root",
    f"""WITH {TURNS}, g AS (SELECT owner, k, sum(amount * exp(-(-20 + k * 0.02) * t)) AS v FROM tt, range(2001) x(k)
    GROUP BY ALL), c AS (SELECT owner, k, sign(v) AS s, lead(sign(v)) OVER (PARTITION BY owner ORDER BY k) AS n FROM g), o AS (SELECT owner, max(t) > 0 AND max(amount) > 0
    AND min(amount) < 0 AS able FROM tt GROUP BY owner),
    m AS (SELECT o.owner, CASE WHEN able THEN count(CASE WHEN s <> n THEN 1 END) ELSE 0 END AS n_roots FROM o JOIN c ON c.owner = o.owner GROUP BY o.owner, able)
    SELECT owner, CASE WHEN n_roots = 1 THEN 'ok' WHEN n_roots > 1 THEN 'multiple_solutions' ELSE 'no_solution' END AS status, n_roots::BIGINT AS n_roots FROM m""",
    lambda s, d: ledgers.xirr_roots(turning(s, d), "owner").select("owner", "status", F.size("roots").alias("n_roots")),
)

# Regression with lagged errors: one factor has a closed form.
add(
    "hac_one_factor",
    f"""WITH {RET}, p AS (SELECT a.date, a.r AS y, b.r AS x, row_number() OVER (ORDER BY a.date) AS k, count(*) OVER () AS n FROM ret a JOIN ret b USING (date) WHERE a.asset = 'A'
    AND b.asset = 'N'),
    m AS (SELECT max(n) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy, floor(4 * (max(n) / 100.0) ** (2 / 9.0)) AS q
    FROM p), b AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM m),
    u AS (SELECT k, x, y - b0 - b1 * x AS u FROM p, b), g AS (SELECT i.k - j.k AS lag, sum(i.u * j.u) AS g00,
    sum(i.u * j.u * j.x) AS g01, sum(i.u * j.u * i.x) AS g10, sum(i.u * j.u * i.x * j.x) AS g11 FROM u i JOIN u j ON i.k - j.k BETWEEN 0 AND (SELECT q FROM b) GROUP BY 1),
    s AS (SELECT sum(w * g00 * f) AS m00, sum(w * (CASE WHEN lag = 0 THEN g01 ELSE g01 + g10 END)) AS m01, sum(w * g11 * f) AS m11 FROM (SELECT *,
    CASE WHEN lag = 0 THEN 1 ELSE 1 - lag / (q + 1) END AS w, CASE WHEN lag = 0 THEN 1 ELSE 2 END AS f FROM g, b)),
    e AS (SELECT b.*, (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / det ** 2 AS v0, (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / det ** 2 AS v1 FROM b, s)
    SELECT 'alpha' AS term, {r('b0 AS beta', 'sqrt(v0) AS error', 'b0 / sqrt(v0) AS t', '1 - (syy - b0 * sy - b1 * sxy) / (syy - sy * sy / n) AS r2')}, q::BIGINT AS lags FROM e
    UNION ALL SELECT 'N', {r('b1 AS beta', 'sqrt(v1) AS error', 'b1 / sqrt(v1) AS t', '1 - (syy - b0 * sy - b1 * sxy) / (syy - sy * sy / n) AS r2')}, q::BIGINT FROM e""",
    lambda s, d: rows(s, [{k: x[k] for k in ("term", "beta", "error", "t", "r2", "lags")}
        for x in solve.hac_rows(v.ret(s, d).where("asset = 'A'").select("date", F.col("r").alias("y")), v.ret(s, d).where("asset = 'N'"))],
            "term string, beta double, error double, t double, r2 double, lags long"),
)


def rows(s: SparkSession, some: list[dict], schema: str) -> DataFrame:
    return s.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in some], schema)


add("hac_regression", None, lambda s, d: rows(s, solve.hac_rows(v.ret(s, d).where("asset = 'A'").select("date", F.col("r").alias("y")), v.ret(s, d).where("asset <> 'A'")),
    "term string, status string, beta double, error double, t double, p double, low double, high double, inflation double, r2 double, lags long"))


# Allocations through the solver on two assets, where methods have closed forms.
def two_assets(s: SparkSession, d: str) -> DataFrame:
    got = risk.covariance(v.ret(s, d).where("asset <> 'R'")).collect()
    cov = np.zeros((2, 2))
    for x in got:
        cov["AN".index(x["i"]), "AN".index(x["j"])] = x["v"]
    found, _ = solve.allocations(cov)
    return s.createDataFrame([(m, a, round(float(x), 5)) for m, w in found.items() for a, x in zip("AN", w)], "method string, asset string, w double")


add(
    "alloc_solver",
    f"""WITH {RET}, cov AS (SELECT a.asset AS i, b.asset AS j, covar_pop(a.r, b.r) AS v FROM ret a JOIN ret b USING (date) WHERE a.asset <> 'R' AND b.asset <> 'R'
    GROUP BY ALL), o AS (SELECT max(CASE WHEN i = 'A' AND j = 'A' THEN v END) AS a, max(CASE WHEN i = 'N' AND j = 'N' THEN v END) AS b, max(CASE WHEN i = 'A'
    AND j = 'N' THEN v END) AS c FROM cov),
    w AS (SELECT 'min_variance' AS method, greatest(0, least(1, (b - c) / (a + b - 2 * c))) AS w FROM o UNION ALL
    SELECT unnest(['risk_parity', 'max_diversification']), sqrt(b) / (sqrt(a) + sqrt(b)) FROM o UNION ALL SELECT 'equal_weight', 0.5)
    SELECT method, 'A' AS asset, round(w, 5) + 0.0 AS w FROM w UNION ALL SELECT method, 'N', round(1 - w, 5) + 0.0 FROM w""",
    two_assets,
)


# Drawdown budget on materialised paths.
def candidates() -> dict[str, np.ndarray]:
    return {"even": np.asarray([0.3, 0.3, 0.3]), "one": np.asarray([0.9, 0.0, 0.0]), "calm": np.asarray([0.1, 0.1, 0.1])}


def returns_of(s: SparkSession, d: str) -> np.ndarray:
    return v.ret(s, d).toPandas().pivot(index="date", columns="asset", values="r").sort_index().to_numpy()


PLAN = budget.Budget(limit=0.25, horizon=252, paths=500, most_paths=2000, blocks=(10, 40), rate=COST, every=63, tolerance=0.02, seed=7)


def screened(s: SparkSession, d: str) -> DataFrame:
    table, best, status = budget.drawdown_budget(s, returns_of(s, d), candidates(), PLAN)
    steps = set(budget.frontier(table))
    return s.createDataFrame([(x["candidate"], x["worst_p95"], x["sensitivity"], x["converged"], x["feasible"], x["score"], x["error"], x["candidate"] == best, x["candidate"] in steps,
        status) for x in table], "candidate string, worst_p95 double, sensitivity double, converged boolean, feasible boolean, score double, error double, selected boolean, on_frontier boolean, status string")


add("drawdown_budget", None, screened)
#: Figures of candidates as a table of suppliers and nations, for the choice itself.
CHOICE = """ch AS (SELECT s_suppkey AS candidate, s_nationkey AS grp, abs(s_acctbal) / 20000 AS worst, s_suppkey % 3 <> 0 AS converged, (s_suppkey % 97) / 97.0 AS score FROM supplier)"""


def chosen(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = v.table(s, d, "supplier").select(k.alias("candidate"), F.col("s_nationkey").alias("grp"), (F.abs("s_acctbal") / 20000).alias("worst"), (k % 3 != 0).alias("converged"),
        ((k % 97) / 97.0).alias("score"))
    fit = F.col("converged") & (F.col("worst") <= 0.25)
    return rows.groupBy("grp").agg(F.max_by("candidate", F.when(fit, F.struct("score", -F.col("candidate")))).alias("selected"),
        F.min_by("candidate", F.struct("worst", "candidate")).alias("least_risk"), F.when(F.bool_or(fit), "ok").when(F.bool_and("converged"), "infeasible").otherwise("unconverged").alias("status"))


add("select_candidate", f"""WITH {CHOICE} SELECT grp::BIGINT AS grp, arg_max(candidate, (score, -candidate)) FILTER (converged
    AND worst <= 0.25) AS selected, arg_min(candidate, (worst, candidate)) AS least_risk, CASE WHEN bool_or(converged
    AND worst <= 0.25) THEN 'ok' WHEN bool_and(converged) THEN 'infeasible' ELSE 'unconverged' END AS status FROM ch GROUP BY grp""", chosen)


def stepped(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = v.table(s, d, "supplier").select(k.alias("candidate"), F.col("s_nationkey").alias("grp"), (F.abs("s_acctbal") / 20000).alias("worst"), ((k % 97) / 97.0).alias("score"))
    before = Window.partitionBy("grp").orderBy("worst", "candidate").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.max("score").over(before)).where("top IS NULL OR score > top").select("grp", "candidate", "worst", "score")


add("frontier", f"""WITH {CHOICE}, f AS (SELECT *, max(score) OVER (PARTITION BY grp ORDER BY worst, candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ch)
    SELECT grp::BIGINT AS grp, candidate, {r('worst', 'score')} FROM f WHERE top IS NULL OR score > top""", stepped)


# Migration.
def moved(s: SparkSession, d: str) -> DataFrame:
    held = {x["asset"]: x["v"] for x in v.daily(s, d).groupBy("asset").agg(F.sum("v").alias("v")).collect()}
    names = sorted(held)
    out = []
    for mode in migration.MODES:
        got = migration.plan(np.asarray([held[a] for a in names]), np.asarray([0.5, 0.3, 0.1]), cash=0.01 * sum(held.values()), costs=np.asarray([0.001, 0.002, 0.0005]), mode=mode)
        out += [(mode, got["status"], a, float(got["buy"][k]), float(got["sell"][k]), got["target_reached"]) if got["status"] == "ok" else (mode, got["status"], a, None, None, False) for k,
            a in enumerate(names)]
    return s.createDataFrame(out, "mode string, status string, asset string, buy double, sell double, reached boolean")


add("migration_plan", None, moved)


def locked(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "customer").where("c_acctbal > 0")
    share = Window.partitionBy("c_nationkey")
    rows = c.select(F.col("c_nationkey").alias("account"), F.col("c_acctbal").alias("amount"),
        (F.lit(1.0) / F.count("*").over(share) * F.when(F.col("c_custkey") % 5 == 0, 0.5).otherwise(1.0)).alias("target"), (F.col("c_custkey") % 10 == 0).alias("fixed"))
    return migration.obstacles(rows, "account")


add(
    "migration_obstacles",
    f"""WITH h AS (SELECT c_nationkey AS account, c_acctbal AS amount, 1.0 / count(*) OVER (PARTITION BY c_nationkey) * CASE WHEN c_custkey % 5 = 0 THEN 0.5 ELSE 1.0 END AS target,
    c_custkey % 10 = 0 AS fixed, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS total FROM customer WHERE c_acctbal > 0)
    SELECT account::BIGINT AS account, count(CASE WHEN fixed AND amount / total > target + 1e-9 THEN 1 END)::BIGINT AS n_obstacles,
    {r('greatest(0, coalesce(max(CASE WHEN fixed AND amount / total > target + 1e-9 THEN amount / target - total END), 0)) AS additional_funds')} FROM h GROUP BY account""",
    locked,
)

# Evaluation.
add("walk_forward", None, lambda s, d: evaluation.walk_forward(v.ret(s, d), least=min(500, v.ret(s, d).select("date").distinct().count() // 2), rate=1e-4)[2])
add(
    "stress_spans",
    f"""WITH RECURSIVE {recursion("('crash', 0.001, true, NULL::DOUBLE, false, true)").replace("w0 AS (SELECT date,", "w0 AS (SELECT date,").replace("FROM ret GROUP BY date)", "FROM ret WHERE date >= DATE '1997-03-01' GROUP BY date)")}, p AS (SELECT *, greatest(1, max(nav) OVER (ORDER BY date)) AS high FROM led WHERE k >= 0), i AS (SELECT *, 1 - nav / high AS fall FROM p WHERE date <= DATE '1998-06-30'),
    t AS (SELECT max(fall) AS mdd, arg_max(date, (fall, -k)) AS trough, arg_max(high, (fall, -k)) AS peak, sum(cost) AS cost FROM i), b AS (SELECT t.*, (SELECT min(date) FROM p
    WHERE date >= trough AND nav >= peak - 1e-12) AS recovered FROM t), mo AS (SELECT min(g) AS worst FROM (SELECT exp(sum(ln(1 + r))) - 1 AS g FROM i
    GROUP BY date_trunc('month', date)))
    SELECT 'crash' AS scenario, CASE WHEN recovered IS NULL THEN 'right_censored' ELSE 'recovered' END AS status, (SELECT count(*)
    FROM i)::BIGINT AS n, {r('(SELECT arg_max(nav, date) - 1 FROM i) AS twr', 'mdd AS max_drawdown', 'cost', 'worst AS worst_month')},
    trough, recovered, {r('(recovered - trough) / 30.4375 AS months')} FROM b, mo
    UNION ALL SELECT 'far', 'insufficient_data', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    lambda s, d: evaluation.stress(v.ret(s, d), EQUAL, {"crash": ("1997-03-01", "1998-06-30"), "far": ("2015-06-01", "2016-01-31")}, COST),
)
add("complete_years", f"""WITH {RET}, y AS (SELECT year(date) AS year, count(DISTINCT date) AS n, min(date) AS a, max(date) AS b FROM ret GROUP BY 1) SELECT x.year::BIGINT AS year, coalesce(n >= 200
    AND dayofyear(a) <= 10 AND strftime(b, '%m%d') >= '1220', false) AS complete FROM (VALUES (1995), (1997), (2015)) x(year) LEFT JOIN y ON y.year = x.year""", lambda s,
        d: evaluation.complete_years(v.ret(s, d).select("date").distinct(), (1995, 1997, 2015), False))


def rolling(s: SparkSession, d: str) -> DataFrame:
    panel = v.ret(s, d)
    least = min(752, panel.select("date").distinct().count() // 2)
    plan = budget.Budget(limit=0.25, horizon=252, paths=250, most_paths=250, blocks=(20,), every=63, tolerance=0.1, seed=7)
    got = evaluation.budget_walk_forward(panel, plan, least=least, step=252, rate=COST, most_folds=2)
    return s.createDataFrame([(x["fold"], x["test_start"], x["test_end"], x["status"], x["selected"], x["max_drawdown"], x["breach"]) for x in got["folds"]],
        "fold int, test_start date, test_end date, status string, selected string, max_drawdown double, breach boolean")


add("budget_walk_forward", None, rolling)
add("stitched_nav", f"""WITH {RET}, p AS (SELECT asset, date, r FROM ret) SELECT asset, date, {r('exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY date)) AS nav')} FROM p""", lambda s,
    d: evaluation.stitched(v.ret(s, d), "asset").select("asset", "date", "nav"))


# The network: each bar of the hourly bars with the seven before it, and the change over the next bar.
def samples(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("security").orderBy("at")
    bars = v.bars(s, d).withColumn("history", F.collect_list(F.struct("open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))).over(w.rowsBetween(-7, 0)))
    told = bars.withColumns({"next": F.lead("close").over(w), "available_at": F.lead("at").over(w)})
    return told.where("size(history) = 8 AND next IS NOT NULL").select(F.concat_ws("|", "security", F.date_format("at", "yyyyMMddHH")).alias("id"), "security",
        F.col("at").alias("signal_at"), "history", (F.col("next") / F.col("close") - 1).alias("y"), "available_at")


HISTORY = """b AS (SELECT event_type AS security, date_trunc('hour', ts) AS at, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL), h AS (SELECT *, count(*) OVER w AS k, first_value(close) OVER w AS f,
    lag(close) OVER o AS c1, lag(close, 2) OVER o AS c2, lead(close) OVER o AS nx FROM b WINDOW o AS (PARTITION BY security ORDER BY at), w AS (PARTITION BY security
    ORDER BY at ROWS 7 PRECEDING))"""
add(
    "network_channels",
    f"""WITH {HISTORY} SELECT security || '|' || strftime(at, '%Y%m%d%H') AS id,
    {r('open / f - 1 AS c0', 'high / f - 1 AS c1', 'low / f - 1 AS c2', 'close / f - 1 AS c3', 'ln(1 + volume) AS c4', '(close - open) / close AS c5', '(high - greatest(open, close)) / close AS c6', '(least(open, close) - low) / close AS c7', 'open / c1 - 1 AS c8', 'close / c2 - 1 AS c9')} FROM h WHERE k = 8 AND nx IS NOT NULL""",
    lambda s, d: network.with_channels(samples(s, d), geometry=True).select("id", *(F.element_at(F.col("channels")[k], -1).alias(f"c{k}") for k in range(10))),
)


def spans(s: SparkSession, d: str) -> DataFrame:
    ends = samples(s, d).agg(F.min("signal_at").alias("a"), F.max("signal_at").alias("b")).first()
    days = max(6, (ends["b"] - ends["a"]).days)
    at = lambda part: (ends["a"] + (ends["b"] - ends["a"]) * part).date()
    import datetime as dt

    one = dt.timedelta(days=1)
    cut = [at(x) for x in (0, 0.4, 0.55, 0.75, 1.0)]
    rows = [("f1", cut[0], cut[1], cut[1] + one, cut[2], cut[2] + one, cut[3]), ("f2", cut[0], cut[2], cut[2] + one, cut[3], cut[3] + one, cut[4])]
    return s.createDataFrame(rows, "fold string, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date") if days else s.createDataFrame([], "fold string")


def fitted(s: SparkSession, d: str, geometry: bool = False) -> DataFrame:
    return network.staged_samples(network.with_channels(samples(s, d), geometry), spans(s, d))


add("cnn_walk_forward", None, lambda s, d: network.fit_folds(fitted(s, d), epochs=4).select("fold", "epoch", "train_loss", "validation_loss", "test_mse", "baseline_mse",
    F.size("scores").alias("n_scores")))


def three_ways(s: SparkSession, d: str) -> DataFrame:
    signal = F.signum(F.element_at("history", -1)["close"] - F.element_at("history", -1)["open"]).cast("int")
    return network.compared(fitted(s, d), fitted(s, d, geometry=True), samples(s, d).select("id", signal.alias("signal")), epochs=2)


add("cnn_compare", None, three_ways)


def predicted(s: SparkSession, d: str) -> DataFrame:
    staged = fitted(s, d)
    model = network.fit_folds(staged.where("fold = 'f1'"), epochs=2).first()["model"]
    return network.predict(network.with_channels(samples(s, d)).drop("y", "available_at"), model)


add("cnn_predict", None, predicted)
