"""Small dense problems that the driver solves on collected matrices of a few dozen assets: allocations, regressions, intervals, migrations."""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import minimise
from .returns import InputError

VALID = 1e-7
#: Normal quantile of a 95 % interval.
Z = 1.959963984540054


@dataclass
class Limits:
    """Bounds of weights, and groups as (indices, least, most) of their sums. Weights sum to 1."""

    lower: np.ndarray
    upper: np.ndarray
    groups: list[tuple[list[int], float, float]] = field(default_factory=list)

    @classmethod
    def long_only(cls, n: int) -> Limits:
        return cls(np.zeros(n), np.ones(n))

    def broken(self, w: np.ndarray) -> float:
        """The largest violation."""
        out = [abs(w.sum() - 1), (self.lower - w).max(), (w - self.upper).max()]
        for ix, lo, hi in self.groups:
            out += [lo - w[ix].sum(), w[ix].sum() - hi]
        return float(max(out))

    def project(self, w: np.ndarray, rounds: int = 400) -> np.ndarray:
        """The nearest weights within the limits, by Dykstra's alternating projections."""
        sets = [self._box_and_sum, *(lambda v, g=g: self._group(v, *g) for g in self.groups)]
        if not self.groups:
            return self._box_and_sum(w)
        rest = [np.zeros_like(w) for _ in sets]
        for _ in range(rounds):
            before = w
            for k, onto in enumerate(sets):
                moved = onto(w + rest[k])
                rest[k], w = w + rest[k] - moved, moved
            if np.abs(w - before).max() < 1e-13 and self.broken(w) < 1e-11:
                break
        return w

    def _box_and_sum(self, w: np.ndarray) -> np.ndarray:
        lo, hi = (w - self.upper).min() - 1, (w - self.lower).max() + 1
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(w - mid, self.lower, self.upper).sum() > 1 else (lo, mid)
        return np.clip(w - (lo + hi) / 2, self.lower, self.upper)

    @staticmethod
    def _group(w: np.ndarray, ix: list[int], lo: float, hi: float) -> np.ndarray:
        out, total = w.copy(), w[ix].sum()
        out[ix] += (min(max(total, lo), hi) - total) / len(ix)
        return out


def feasible_point(limits: Limits) -> np.ndarray | None:
    """Weights within the limits, by the linear programme over bounds, groups and the sum; None if there are none."""
    n = len(limits.lower)
    rows, right = [], []
    for ix, lo, hi in limits.groups:
        member = np.zeros(n)
        member[ix] = 1.0
        rows += [member, -member]
        right += [hi - limits.lower[ix].sum(), limits.lower[ix].sum() - lo]
    room = limits.upper - limits.lower
    left = 1 - limits.lower.sum()
    if (room < 0).any() or left < -1e-12:
        return None
    got = minimise(np.zeros(n), np.vstack([*rows, np.eye(n)]), np.concatenate([right, room]), np.ones((1, n)), np.asarray([left]))
    return None if got is None else got + limits.lower


def _descend(gradient, value, limits: Limits, start: np.ndarray, rounds: int = 3000) -> tuple[np.ndarray, bool]:
    """Projected gradient with backtracking: the weights, and whether they stopped moving."""
    w, step, f = start, 1.0, value(start)
    for _ in range(rounds):
        g = gradient(w)
        while step > 1e-14:
            new = limits.project(w - step * g)
            change = new - w
            if value(new) <= f + g @ change + (change @ change) / (2 * step) + 1e-18:
                break
            step /= 2
        w, old, f = new, f, value(new)
        if np.abs(change).max() < 1e-12 or (old - f < 1e-16 * max(1.0, abs(f)) and np.abs(change).max() < 1e-9):
            return w, True
        step *= 1.6
    return w, False


def allocations(cov: np.ndarray, limits: Limits | None = None, views: dict | None = None) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """Weights by method, and why a method failed. Infeasible limits leave no candidates. ``views``: mean and risk aversion for the utility method."""
    n = len(cov)
    limits = limits or Limits.long_only(n)
    if feasible_point(limits) is None:
        return {}, {"all": "infeasible"}
    start = limits.project(np.full(n, 1 / n))
    if limits.broken(start) > VALID:
        return {}, {"all": "no start within the limits was found"}
    scale = cov / (np.trace(cov) / n)
    sigma = np.sqrt(np.diag(scale))

    def share_gap(w: np.ndarray) -> float:
        c = w * (scale @ w)
        return float(((c / c.sum() - 1 / n) ** 2).sum())

    def share_slope(w: np.ndarray) -> np.ndarray:
        m = scale @ w
        v = w @ m
        e = 2 * (w * m / v - 1 / n)
        return e * m / v + scale @ (e * w) / v - 2 * (e @ (w * m)) / v**2 * m

    def spread(w: np.ndarray) -> float:
        return float(-(w @ sigma) / math.sqrt(w @ scale @ w))

    def spread_slope(w: np.ndarray) -> np.ndarray:
        v = w @ scale @ w
        return -sigma / math.sqrt(v) + (w @ sigma) * (scale @ w) / v**1.5

    equal = "equal_weight" if np.allclose(start, 1 / n) else "constrained_equal_reference"
    found = {
        equal: (start, True),
        "min_variance": _descend(lambda w: 2 * scale @ w, lambda w: float(w @ scale @ w), limits, start),
        "risk_parity": _descend(share_slope, share_gap, limits, start),
        "max_diversification": _descend(spread_slope, spread, limits, start),
    }
    if views:
        mean, delta = np.asarray(views["mean"]), views["delta"]
        found["black_litterman"] = _descend(lambda w: delta * cov @ w - mean, lambda w: float(delta / 2 * w @ cov @ w - mean @ w), limits, start)
    failed = {m: "the solver did not converge" for m, (_, sure) in found.items() if not sure}
    failed |= {m: "limits are broken" for m, (w, _) in found.items() if not np.isfinite(w).all() or limits.broken(w) > VALID}
    return {m: w for m, (w, _) in found.items() if m not in failed}, failed


def allocation_status(found: dict, failed: dict) -> str:
    """infeasible without any candidate, degraded if a method failed, else ok."""
    return "infeasible" if not found else "degraded" if failed else "ok"


def shrunk(x: np.ndarray) -> tuple[np.ndarray, dict]:
    """Population covariance of rows of returns, shrunk to its mean variance (Ledoit and Wolf 2004), with the weight of the target, conditions before and after and the least
    eigenvalue."""
    n, p = x.shape
    c = x - x.mean(axis=0)
    sample = c.T @ c / n
    mean = np.trace(sample) / p
    apart = ((sample - mean * np.eye(p)) ** 2).sum() / p
    noise = max(0.0, ((c**2).T @ (c**2) / n - sample**2).sum() / (n * p))
    weight = min(noise, apart) / apart if apart > 0 else 0.0
    out = (1 - weight) * sample + weight * mean * np.eye(p)
    before, after = np.linalg.eigvalsh(sample), np.linalg.eigvalsh(out)
    ratio = lambda v: float(v[-1] / v[0]) if v[0] > 0 else math.inf
    return out, {"shrinkage": float(weight), "condition_before": ratio(before), "condition_after": ratio(after), "least_eigenvalue": float(after[0]), "observations": n}


def black_litterman(cov: np.ndarray, market: np.ndarray, p: np.ndarray, q: np.ndarray, omega: np.ndarray, tau: float, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """(posterior mean, predictive covariance): prior delta C w, gain tau C P' (tau P C P' + O)^-1."""
    prior = delta * cov @ market
    middle = tau * p @ cov @ p.T + omega
    gain = np.linalg.solve(middle, tau * p @ cov).T
    return prior + gain @ (q - p @ prior), cov + tau * cov - gain @ (tau * p @ cov)


def hac_regression(y: np.ndarray, x: np.ndarray, lags: int | None = None) -> dict:
    """Least squares with Bartlett-weighted (Newey-West) errors and normal p-values; insufficient without k + 5 rows, invalid if factors depend on each other,
    degraded if a variance inflation is above 10."""
    n, k = x.shape
    if n <= k + 5:
        return {"status": "insufficient_data"}
    if lags is not None and lags < 0:
        raise InputError("lags must not be negative")
    lags = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    full = np.column_stack([np.ones(n), x])
    if np.linalg.matrix_rank(full) < k + 1:
        return {"status": "invalid"}
    inverse = np.linalg.inv(full.T @ full)
    beta = inverse @ full.T @ y
    u = full * (y - full @ beta)[:, None]
    meat = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    error = np.sqrt(np.diag(inverse @ meat @ inverse))
    t = beta / error
    norm = statistics.NormalDist()
    centred = x - x.mean(axis=0)
    inflation = np.diag(np.linalg.inv(centred.T @ centred)) * (centred**2).sum(axis=0)
    total = ((y - y.mean()) ** 2).sum()
    return {
        "status": "degraded" if (inflation > 10).any() else "ok",
        "beta": beta[1:],
        "alpha": beta[0],
        "error": error,
        "t": t,
        "p": np.asarray([2 * norm.cdf(-abs(v)) for v in t]),
        "low": beta - Z * error,
        "high": beta + Z * error,
        "r2": 1 - ((y - full @ beta) ** 2).sum() / total if total > 0 else None,
        "inflation": inflation,
        "lags": lags,
    }


def hac_moments(excess: DataFrame, factors: DataFrame, lags: int | None = None) -> tuple[dict, list[str]]:
    """Sums that a regression of ``excess`` (date, y) on ``factors`` (date, asset, r) needs, by aggregates over the joined dates: only sums over pairs of factors and lags
    reach the driver. A date that a side lacks raises."""
    names = sorted(r["asset"] for r in factors.select("asset").distinct().collect())
    wide = factors.groupBy("date").pivot("asset", names).agg(F.first("r"))
    wide = wide.toDF("date", *(f"x{k}" for k in range(len(names))))
    joined = excess.join(wide, "date", "full")
    cols = ["y", *(f"x{k}" for k in range(len(names)))]
    bad = joined.where(F.col("date").isNull() | F.greatest(*(F.col(c).isNull().cast("int") for c in cols)).cast("boolean"))
    if not bad.isEmpty():
        raise InputError("factors and returns must have the same dates")
    terms = ["1D", *cols]
    sums = joined.agg(*(F.sum(F.expr(f"{a} * {b}")).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j)).first()
    n = int(sums["s0_0"] or 0)
    return {"joined": joined, "sums": sums, "n": n, "lags": int(4 * (max(n, 1) / 100) ** (2 / 9)) if lags is None else lags}, names


def hac_rows(excess: DataFrame, factors: DataFrame, lags: int | None = None) -> list[dict]:
    """:func:`hac_regression` without the driver ever holding a series: cross products are aggregates, and products of residuals at each lag are aggregates over lagged rows in date
    order. One row for each term, with status."""
    got, names = hac_moments(excess, factors, lags)
    k, n, q = len(names), got["n"], got["lags"]
    if q < 0:
        raise InputError("lags must not be negative")
    if n <= k + 5:
        return [{"term": None, "status": "insufficient_data"}]
    s = lambda i, j: float(got["sums"][f"s{min(i, j)}_{max(i, j)}"])
    at = [0, *range(2, k + 2)]  # the constant and the factors; 1 is y
    gram = np.asarray([[s(i, j) for j in at] for i in at])
    scale = np.sqrt(np.diag(gram))
    if (scale <= 0).any() or np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10) < k + 1:
        return [{"term": None, "status": "invalid"}]
    inverse = np.linalg.inv(gram)
    beta = inverse @ np.asarray([s(1, i) for i in at])
    told = F.col("y") - F.lit(float(beta[0]))
    for j in range(k):
        told = told - F.lit(float(beta[j + 1])) * F.col(f"x{j}")
    rows = got["joined"].withColumn("u", told)
    # In date order within ranges of dates: each range is joined with the rows before it that its lags reach.
    moved = [F.col("u"), *(F.col("u") * F.col(f"x{j}") for j in range(k))]
    scored = rows.select("date", *(m.alias(f"m{j}") for j, m in enumerate(moved)))
    ordered = Window.orderBy("date")  # one row for each date: dates are few, whatever the table that returns come from
    for lag in range(1, q + 1):
        scored = scored.withColumns({f"m{j}_{lag}": F.lag(f"m{j}", lag).over(ordered) for j in range(k + 1)})
    pairs = [(i, j, lag) for lag in range(q + 1) for i in range(k + 1) for j in range(k + 1)]
    sums = scored.agg(*(F.sum(F.col(f"m{i}") * F.col(f"m{j}" if not lag else f"m{j}_{lag}")).alias(f"g{i}_{j}_{lag}") for i, j, lag in pairs)).first()
    meat = np.zeros((k + 1, k + 1))
    for lag in range(q + 1):
        g = np.asarray([[sums[f"g{i}_{j}_{lag}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
        meat += g if not lag else (1 - lag / (q + 1)) * (g + g.T)
    error = np.sqrt(np.diag(inverse @ meat @ inverse))
    centred = np.asarray([[s(i, j) - s(0, i) * s(0, j) / n for j in at[1:]] for i in at[1:]])
    inflation = np.diag(np.linalg.inv(centred)) * np.diag(centred)
    total = s(1, 1) - s(0, 1) ** 2 / n
    left = s(1, 1) - float(beta @ np.asarray([s(1, i) for i in at]))
    norm = statistics.NormalDist()
    status = "degraded" if (inflation > 10).any() else "ok"
    out = []
    for i, name in enumerate(["alpha", *names]):
        t = float(beta[i] / error[i]) if error[i] > 0 else float("nan")
        out.append({"term": name, "status": status, "beta": float(beta[i]), "error": float(error[i]), "t": t, "p": 2 * norm.cdf(-abs(t)), "low": float(beta[i] - Z * error[i]),
            "high": float(beta[i] + Z * error[i]), "inflation": float(inflation[i - 1]) if i else None, "r2": 1 - left / total if total > 0 else None, "lags": q})
    return out


#: Fixed value: fewer values than these say nothing about a quantile.
LEAST_VALUES = 20


def below_chances(n: int, p: float) -> np.ndarray:
    """For k from 1 to n the chance that fewer than k of n independent values lie below their p quantile: the distribution function of a binomial count."""
    k = np.arange(n)
    choose = math.lgamma(n + 1) - np.asarray([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k])
    return np.cumsum(np.exp(choose + k * math.log(p) + (n - k) * math.log1p(-p)))


def interval_ranks(n: int, p: float, confidence: float = 0.95) -> tuple[int, int] | None:
    """Ranks (from 1) of the greatest order statistic that lies above the p quantile, and of the least that lies at or below it, each with no more chance than its half of what the
    confidence leaves. None where no such rank exists."""
    if n < LEAST_VALUES:
        return None
    chance, spare = below_chances(n, p), (1 - confidence) / 2 + 1e-12
    low, high = np.flatnonzero(chance <= spare), np.flatnonzero(1 - chance <= spare)
    return (int(low[-1]) + 1, int(high[0]) + 1) if len(low) and len(high) else None


def quantile_interval(values: np.ndarray, p: float, confidence: float = 0.95) -> tuple[float, float]:
    """The order statistics of :func:`interval_ranks`; raises where the sample can't support the tail."""
    ranks = interval_ranks(len(values), p, confidence)
    if ranks is None:
        raise InputError("too few values for this quantile")
    at = np.asarray(ranks) - 1
    return tuple(np.partition(np.asarray(values, dtype=float), at)[at].tolist())


def neutral_scores(values: np.ndarray, industry: list[str], log_cap: np.ndarray, weights: np.ndarray) -> dict:
    """Scores of a cross-section (securities by factors): standardised, freed of industry and size by least squares, standardised again, weighted."""
    def z(x: np.ndarray) -> np.ndarray:
        s = x.std(axis=0)
        if (s <= 1e-12).any():
            raise InputError("a factor doesn't vary")
        return (x - x.mean(axis=0)) / s

    names = sorted(set(industry))
    control = np.column_stack([np.ones(len(values)), *(np.asarray([i == n for i in industry], float) for n in names[1:]), log_cap])
    if np.linalg.matrix_rank(control) < control.shape[1]:
        raise InputError("controls depend on each other")
    scored = z(values)
    neutral = z(scored - control @ np.linalg.lstsq(control, scored, rcond=None)[0])
    return {"neutral": neutral, "score": neutral @ weights, "correlation": np.corrcoef(neutral, rowvar=False)}


def migration_diagnosis(current: np.ndarray, target: np.ndarray, cash: float, fee: np.ndarray, locked: np.ndarray, mode: str = "one_step") -> dict:
    """Trades from current amounts to target parts: in one step with costs, or by buying only from cash. Locked holdings can't be sold."""
    from .backtest import rebalanced

    total = float(current.sum() + cash)
    if total <= 0 or (current < 0).any():
        raise InputError("holdings must be worth something")
    if mode == "buy_only":
        gap = np.maximum(target * total - current, 0)
        asked = float(gap @ (1 + fee))
        buys = gap * (min(1.0, cash / asked) if asked > 0 else 0.0)
        cost = float((buys * fee).sum())
        return {"status": "ok", "trades": buys, "cost": cost, "cash": cash - buys.sum() - cost}
    held, left, cost = rebalanced(current, cash, target, fee)
    if (locked & (held < current - 1e-9)).any():
        return {"status": "infeasible", "reason": "a locked holding would be sold"}
    return {"status": "ok", "trades": held - current, "cost": cost, "cash": left}
