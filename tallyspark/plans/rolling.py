"""Queries of rolling estimates and of budgets on accounts' own series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budget, evaluation, ledgers, moments
from . import views as v
from .catalog import RET, U
from .registry import add, r

#: Dates before the first fold, of a fold, and of a window, as shares of all dates; the same in SQL.
FOLDS, SHARE = 6, 8


def spans(n: int) -> list[tuple[int, int, int]]:
    """Windows of three eighths of the dates, each an eighth or so behind the one before."""
    step, window = n // SHARE, 3 * n // SHARE
    return [(f, max(0, (f + 2) * step - window), (f + 2) * step) for f in range(FOLDS)]


def rolled(s: SparkSession, d: str) -> DataFrame:
    ret = v.ret(s, d)
    numbered = evaluation.numbered(ret)
    return moments.rolling_covariances(ret, numbered, spans(numbered.count())).withColumn("v", 1e4 * F.col("v"))


add(
    "rolling_covariance",
    f"""WITH {RET}, nb AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ret)),
    f AS (SELECT fold, greatest(0, (fold + 2) * (n // {SHARE}) - 3 * n // {SHARE}) AS lo, (fold + 2) * (n // {SHARE}) AS hi FROM (SELECT DISTINCT n
    FROM nb), range({FOLDS}) x(fold)),
    w AS (SELECT fold, asset, ret.date, r - avg(r) OVER (PARTITION BY fold, asset) AS x FROM ret JOIN nb ON nb.date = ret.date JOIN f ON k >= lo AND k < hi),
    c AS (SELECT a.fold, a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, avg((a.x * b.x) ** 2) AS q, count(*) AS n FROM w a JOIN w b ON a.fold = b.fold AND a.date = b.date
    GROUP BY ALL),
    m AS (SELECT fold, sqrt(count(*)) AS p, sum(CASE WHEN i = j THEN s END) / sqrt(count(*)) AS mu, sum(q - s * s) AS e, max(n) AS n FROM c GROUP BY fold),
    g AS (SELECT m.fold, mu, greatest(0, e) / (max(m.n) * max(p)) AS noise, sum((s - CASE WHEN i = j THEN mu ELSE 0 END) ** 2) / max(p) AS apart FROM c JOIN m ON m.fold = c.fold
    GROUP BY m.fold, mu, e),
    h AS (SELECT *, CASE WHEN apart > 0 THEN least(noise, apart) / apart ELSE 0 END AS shrinkage FROM g)
    SELECT c.fold::BIGINT AS fold, i, j, {r('1e4 * ((1 - shrinkage) * s + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END) AS v', 'shrinkage')}, n::BIGINT AS n FROM c
    JOIN h ON h.fold = c.fold""",
    rolled,
)


# Accounts that trade fixed amounts each January at three fee rates, by months; the budget works on what they are worth after fees.
def monthly(s: SparkSession, d: str) -> DataFrame:
    month = (F.year("date") * 12 + F.month("date")).alias("ix")
    rets = v.ret(s, d).groupBy(month, F.col("asset").alias("security")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
    trades = rets.where("ix % 12 = 1").select("ix", "security", F.lit(10.0).alias("notional"))
    rates = s.range(1).select(F.explode(F.array(*map(F.lit, (0, 40, 900)))).alias("bps"))
    return ledgers.fixed_notional(rates.crossJoin(rets.select("ix").distinct()), rets, trades.crossJoin(rates), 400.0, "bps", bps=F.col("bps"))


def chosen(s: SparkSession, d: str) -> DataFrame:
    returns = budget.net_returns(monthly(s, d), 400.0, "bps").withColumnRenamed("bps", "account")
    return budget.screened(returns, 0.2, 24)


N = "(SELECT count(*) FROM rr WHERE account = 0)"
add(
    "account_budget",
    f"""WITH {RET}, y AS (SELECT year(date) * 12 + month(date) AS ix, asset AS security, exp(sum(ln(1 + r))) - 1 AS r FROM ret GROUP BY ALL),
    cum AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY security ORDER BY ix)) AS g FROM y),
    h AS (SELECT a.ix, sum(10 * a.g / b.g * (1 + b.r)) AS held FROM cum b JOIN cum a ON a.security = b.security AND a.ix >= b.ix WHERE b.ix % 12 = 1 GROUP BY a.ix),
    t AS (SELECT ix, 10.0 * count(*) AS spent FROM y WHERE ix % 12 = 1 GROUP BY ix),
    e AS (SELECT bps AS account, i.ix, 400 - sum(coalesce(spent, 0)) OVER w + coalesce(held, 0) - sum(coalesce(spent, 0) * bps / 10000) OVER w AS net
        FROM (SELECT DISTINCT ix FROM y) i LEFT JOIN h ON h.ix = i.ix LEFT JOIN t ON t.ix = i.ix, (SELECT unnest([0, 40, 900]) AS bps)
        WINDOW w AS (PARTITION BY bps ORDER BY i.ix)),
    rr AS (SELECT account, net / coalesce(lag(net) OVER w, 400) - 1 AS r, row_number() OVER w - 1 AS row_ix FROM e WINDOW w AS (PARTITION BY account ORDER BY ix)),
    cells AS (SELECT p AS path, st AS step FROM range(200) a(p), range(24) b(st)),
    jm AS (SELECT path, step, CASE WHEN step = 0 OR {U.format(t='restart')} < 1 / 10.0 THEN step END AS s, floor({U.format(t='start')} * {N}) AS u FROM cells),
    kk AS (SELECT *, max(s) OVER (PARTITION BY path ORDER BY step) AS b FROM jm), boot AS (SELECT kk.path, kk.step, ((o.u + kk.step - kk.b)::BIGINT % {N}) AS row_ix FROM kk
    JOIN kk o ON o.path = kk.path AND o.step = kk.b),
    nv AS (SELECT account, path, step, exp(sum(ln(1 + r)) OVER (PARTITION BY account, path ORDER BY step)) AS nav FROM boot JOIN rr ON rr.row_ix = boot.row_ix),
    dd AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER (PARTITION BY account, path ORDER BY step)) AS fall FROM nv),
    each AS (SELECT account, path, max(fall) AS fall, arg_max(nav, step) AS growth FROM dd GROUP BY ALL),
    q AS (SELECT account, quantile_cont(fall, 0.95) AS p95, quantile_cont(growth, 0.5) AS median FROM each GROUP BY account),
    best AS (SELECT arg_max(account, (median, -account)) AS best FROM q WHERE p95 <= 0.2)
    SELECT account::BIGINT AS account, {r('p95', 'median')}, p95 <= 0.2 AS feasible, coalesce(account = best, false) AS chosen FROM q LEFT JOIN best ON true""",
    chosen,
)
