"""Path risk, tail risk, moments and simple allocations, from (date, asset, r)."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .returns import by_date
from .scan import beside, growth_and_high, running
from .select import order_statistics
from .stage import written

TINY = 1e-15


def nav_path(returns: DataFrame, *keys: str) -> DataFrame:
    """``returns`` with nav, the running product of 1 + r."""
    return running(returns, *keys, products={"nav": 1 + F.col("r")})


def drawdown_path(returns: DataFrame, *keys: str) -> DataFrame:
    """With nav and underwater: the fall from the running high, which the start at 1 is part of."""
    path = growth_and_high(returns, 1 + F.col("r"), *keys)
    return path.withColumn("underwater", 1 - F.col("nav") / F.greatest(F.lit(1.0), "high")).drop("high")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > TINY, a / b)


def summary(returns: DataFrame, *keys: str, periods: float = 252.0, risk_free: float = 0.0) -> DataFrame:
    """One row for each path: n, twr, cagr, volatility, sharpe, sortino, calmar, max_drawdown, ulcer. The ulcer index averages over the start too; the
    downside over all rows; ratios are null where the divisor vanishes."""
    rf = (1 + risk_free) ** (1 / periods) - 1
    x = F.col("r") - rf
    path = drawdown_path(returns, *keys)
    base = path.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.log1p("r")).alias("logs"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))).alias("down"),
        F.max("underwater").alias("max_drawdown"),
        F.sum(F.pow("underwater", F.lit(2))).alias("depth"),
    )
    cagr = F.expm1(F.col("logs") * periods / F.col("n"))
    root = periods**0.5
    return base.select(
        *keys, "n", F.expm1("logs").alias("twr"), cagr.alias("cagr"), (F.col("std") * root).alias("volatility"), ratio(F.col("mean") * root, F.col("std")).alias("sharpe"),
            ratio(F.col("mean") * root, F.col("down")).alias("sortino"),
        ratio(cagr, F.col("max_drawdown")).alias("calmar"), "max_drawdown", F.sqrt(F.col("depth") / (F.col("n") + 1)).alias("ulcer"),
    )


def expected_shortfall(returns: DataFrame, *keys: str, alpha: float = 0.95, least_tail: float = 30.0) -> DataFrame:
    """Mean of the worst (1 - alpha) n losses with the boundary loss in part, the interpolated quantile, and whether the tail has ``least_tail`` rows. Boundary and quantile are
    order statistics, which need no group to be sorted in one task."""
    losses = written(returns.select(*keys, (-F.col("r")).alias("loss")), "losses")
    tail, at = (1 - alpha) * F.col("n"), alpha * (F.col("n") - 1)
    told = order_statistics(losses, "loss", {"edge": F.col("n") - F.ceil(tail) + 1, "low": F.floor(at) + 1, "high": F.ceil(at) + 1}, *keys)
    told = told.select(*keys, "n", "edge", tail.alias("tail"), (F.col("low") + (at - F.floor(at)) * (F.col("high") - F.col("low"))).alias("var"))
    above = F.col("loss") > F.col("edge")
    sums = beside(losses, told, *keys).groupBy(*keys, "n", "tail", "edge", "var").agg(F.coalesce(F.sum(F.when(above, F.col("loss"))), F.lit(0.0)).alias("s"), F.count_if(above).alias("m"))
    out = sums.select(*keys, "n", ((F.col("s") + (F.col("tail") - F.col("m")) * F.col("edge")) / F.col("tail")).alias("es"), "var")
    return out.withColumn("status", F.when((1 - alpha) * F.col("n") < least_tail, "insufficient_data").otherwise("ok"))


def worst_month(returns: DataFrame, *keys: str) -> DataFrame:
    months = returns.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
    return months.groupBy(*keys).agg(F.min(F.struct("r", "month")).alias("w")).select(*keys, F.col("w.month").alias("month"), F.col("w.r").alias("r"))


def rolling_holding(returns: DataFrame, span: int, years: float, *keys: str) -> DataFrame:
    """Annualised returns of all overlapping spans: n, p05, median, p95, share of losses."""
    w = by_date(*keys).rowsBetween(1 - span, 0)
    full = returns.withColumn("logs", F.sum(F.log1p("r")).over(w)).withColumn("n", F.count("*").over(w)).where(F.col("n") == span).withColumn("held", F.expm1(F.col("logs") / years))
    return full.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile("held", F.lit(q)).alias(n) for q, n in ((0.05, "p05"), (0.5, "median"), (0.95, "p95"))),
        F.avg((F.col("held") < 0).cast("double")).alias("loss_share"))


def covariance(returns: DataFrame) -> DataFrame:
    """(i, j, v, n) population covariances of all pairs of assets, by one join on the date."""
    a, b = returns.select("date", F.col("asset").alias("i"), F.col("r").alias("x")), returns.select("date", F.col("asset").alias("j"), F.col("r").alias("y"))
    return a.join(b, "date").groupBy("i", "j").agg(F.covar_pop("x", "y").alias("v"), F.count("*").alias("n"))


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """(i, j, v, shrinkage): covariances shrunk to the mean variance times the unit matrix (Ledoit and Wolf 2004)."""
    means = returns.groupBy("asset").agg(F.avg("r").alias("m"))
    centred = returns.join(means, "asset").select("date", "asset", (F.col("r") - F.col("m")).alias("x"))
    a, b = centred.select("date", F.col("asset").alias("i"), "x"), centred.select("date", F.col("asset").alias("j"), F.col("x").alias("y"))
    s = a.join(b, "date").groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.pow(F.col("x") * F.col("y"), F.lit(2))).alias("q"), F.count("*").alias("n"))
    one = s.agg(F.sqrt(F.count("*").cast("double")).alias("p"), F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("trace"), F.sum(F.col("s") * F.col("s")).alias("ss"),
        F.sum("q").alias("qq"), F.max("n").alias("n"))
    mu = F.col("trace") / F.col("p")
    delta = (F.col("ss") - F.col("p") * mu * mu) / F.col("p")
    beta = F.least((F.col("qq") - F.col("ss")) / (F.col("p") * F.col("n")), delta)
    one = one.select(mu.alias("mu"), F.when(beta <= 0, 0.0).otherwise(beta / delta).alias("shrinkage"))
    return s.select("i", "j", "s").join(F.broadcast(one)).select("i", "j",
        ((1 - F.col("shrinkage")) * F.col("s") + F.when(F.col("i") == F.col("j"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)).alias("v"), "shrinkage")


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(asset, w, share) with share = w (Cw) / w'Cw, null where the variance vanishes."""
    wi, wj = weights.select(F.col("asset").alias("i"), F.col("w").alias("wi")), weights.select(F.col("asset").alias("j"), F.col("w").alias("wj"))
    each = cov.join(wi, "i").join(wj, "j").groupBy("i").agg(F.first("wi").alias("w"), F.sum(F.col("wi") * F.col("v") * F.col("wj")).alias("c"))
    total = each.agg(F.sum("c").alias("variance"))
    return each.join(F.broadcast(total)).select(F.col("i").alias("asset"), "w", F.when(F.col("variance") > 1e-18, F.col("c") / F.col("variance")).alias("share"))


def concentration(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Effective numbers of assets by weight and by risk, diversification ratio, cash weight."""
    shares = risk_contributions(cov, weights)
    risk = shares.agg(F.when(F.min("share") >= -1e-12, 1 / F.sum(F.col("share") * F.col("share"))).alias("risk_assets"),
        (F.pow(F.sum("w"), F.lit(2)) / F.sum(F.col("w") * F.col("w"))).alias("weight_assets"), (1 - F.sum("w")).alias("cash"))
    own = cov.where("i = j").join(weights.withColumnRenamed("asset", "i"), "i").agg(F.sum(F.col("w") * F.sqrt("v")).alias("alone"))
    wi, wj = weights.select(F.col("asset").alias("i"), F.col("w").alias("wi")), weights.select(F.col("asset").alias("j"), F.col("w").alias("wj"))
    whole = cov.join(wi, "i").join(wj, "j").agg(F.sum(F.col("wi") * F.col("v") * F.col("wj")).alias("variance"))
    return risk.join(own).join(whole).select("weight_assets", "risk_assets", ratio(F.col("alone"), F.sqrt("variance")).alias("diversification"), "cash")


def two_asset_weights(cov: DataFrame, first: str, second: str) -> DataFrame:
    """(method, asset, w) in closed form for two assets: least variance clipped to [0, 1], equal risk and greatest diversification (both by inverse volatility)."""
    pick = lambda i, j: F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
    one = cov.agg(pick(first, first).alias("a"), pick(second, second).alias("b"), pick(first, second).alias("c"))
    gmv = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("b") - F.col("c")) / (F.col("a") + F.col("b") - 2 * F.col("c"))))
    inverse = F.sqrt("b") / (F.sqrt("a") + F.sqrt("b"))
    rows = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(x).alias("asset"), w.alias("w")) for m,
        w1 in (("min_variance", gmv), ("risk_parity", inverse), ("max_diversification", inverse)) for x, w in ((first, w1), (second, 1 - w1))))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def black_litterman_one_view(cov: DataFrame, weights: DataFrame, view: dict[str, float], q: float, omega: float, tau: float, delta: float) -> DataFrame:
    """(asset, prior, posterior) for a single view p'mu = q with variance omega: prior delta C w, gain tau C p / (tau p'Cp + omega)."""
    p = F.coalesce(*(F.when(F.col("j") == a, F.lit(v)) for a, v in view.items()), F.lit(0.0))
    pi = F.coalesce(*(F.when(F.col("i") == a, F.lit(v)) for a, v in view.items()), F.lit(0.0))
    each = cov.join(weights.select(F.col("asset").alias("j"), "w"), "j").groupBy("i").agg((delta * F.sum(F.col("v") * F.col("w"))).alias("prior"), F.sum(F.col("v") * p).alias("cp"))
    one = each.agg(F.sum(pi * F.col("prior")).alias("told"), F.sum(pi * F.col("cp")).alias("pcp"))
    return each.join(F.broadcast(one)).select(F.col("i").alias("asset"), "prior", (F.col("prior") + tau * F.col("cp") * (q - F.col("told")) / (tau * F.col("pcp") + omega)).alias("posterior"))


def cornish_fisher(skew: float, kurtosis: float, alpha: float) -> float | None:
    """Quantile of the loss by the Cornish-Fisher expansion, or None where the expansion isn't increasing on [-4, 4]."""
    f = lambda z: z + (z * z - 1) * skew / 6 + (z**3 - 3 * z) * kurtosis / 24 - (2 * z**3 - 5 * z) * skew * skew / 36
    grid = [f(-4 + 8 * k / 2000) for k in range(2001)]
    return f(statistics.NormalDist().inv_cdf(alpha)) if all(b > a for a, b in zip(grid, grid[1:])) else None


def recovery(returns: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Greatest fall between ``start`` and ``end``, its trough (first day of the maximum), its peak, and the first day after it on which the peak is reached
    again, which may lie beyond the end; else right_censored."""
    path = drawdown_path(returns.where(F.col("date") >= F.lit(start).cast("date")), *keys)
    inside = path.where(F.col("date") <= F.lit(end).cast("date"))
    trough = inside.groupBy(*keys).agg(F.max("underwater").alias("max_drawdown"), F.max(F.struct("underwater", (-F.unix_date("date")).alias("k"))).alias("t")).withColumn("trough",
        F.date_from_unix_date(-F.col("t.k")))
    peak = path.join(trough.select(*keys, "trough"), list(keys)).where("date <= trough").groupBy(*keys).agg(F.greatest(F.lit(1.0), F.max("nav")).alias("high"))
    marked = trough.join(peak, list(keys)).select(*keys, "max_drawdown", "trough", "high")
    back = path.join(marked, list(keys)).where((F.col("date") > F.col("trough")) & (F.col("nav") >= F.col("high") - 1e-12)).groupBy(*keys).agg(F.min("date").alias("recovered"))
    out = marked.join(back, list(keys), "left")
    return out.select(*keys, "max_drawdown", "trough", "recovered", (F.datediff("recovered", "trough") / 30.4375).alias("months"),
        F.when(F.col("recovered").isNull(), "right_censored").otherwise("recovered").alias("status"))


def rate_shock(duration: Column, convexity: Column, change: Column) -> Column:
    """Part of its price that a bond gains when its yield changes: - duration * change + convexity * change^2 / 2."""
    return -duration * change + 0.5 * convexity * change * change
