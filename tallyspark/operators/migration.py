"""From what is held to target weights, under costs and locks: a linear programme in amounts, and a diagnosis in SQL terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import minimise, nearest
from .returns import InputError

MODES = ("buy_only", "minimum_trade", "one_step")


def plan(current: np.ndarray, target: np.ndarray, cash: float = 0.0, new_funds: float = 0.0, costs: float | np.ndarray = 1e-4, locked: tuple[int, ...] = (), mode: str = "minimum_trade",
    penalty: float = 1.0, improvement: float | None = None) -> dict:
    """Buys and sells with the least costs plus ``penalty`` times the distance from the target in money; one_step must reach the target, buy_only sells nothing, and
    what is ``locked`` is never sold. Of plans that cost the same, the one with the least squared distances is taken. ``improvement`` is the expected
    gain a year as a part of the account, for the years until the costs are earned."""
    x = np.asarray(current, dtype=float)
    t = np.asarray(target, dtype=float)
    n = len(x)
    rates = np.broadcast_to(np.asarray(costs, dtype=float), (n,))
    funds = float(cash + new_funds)
    total = float(x.sum() + funds)
    if mode not in MODES or t.shape != x.shape or not n:
        raise InputError("unknown mode, or targets that don't fit the holdings")
    if not np.isfinite(x).all() or (x < 0).any() or (t < 0).any() or t.sum() > 1 + 1e-9 or min(cash, new_funds, penalty) < 0 or total <= 0:
        raise InputError("holdings, weights, funds and penalty must not be negative, and the account not empty")
    if (rates < 0).any() or (rates >= 1).any() or any(i not in range(n) for i in locked):
        raise InputError("costs are shares below 1, locks are places of holdings")
    fixed = np.ones(n, bool) if mode == "buy_only" else np.isin(np.arange(n), list(locked))

    # In parts of the account: buys, sells, and the distance of each holding and of cash from its target.
    parts = np.append(x, funds) / total
    move = np.zeros((n + 1, 2 * n))
    move[:n, :n], move[:n, n:] = np.eye(n), -np.eye(n)
    move[n, :n], move[n, n:] = -(1 + rates), 1 - rates
    goal = np.append(t, 1 - t.sum())
    paid = np.concatenate([rates, rates])
    gap_of, gap_at = move + np.outer(goal, paid), parts - goal  # goal of what is left after costs
    none = np.zeros((2 * n, n + 1))
    rows = [np.concatenate([s * gap_of[i], -np.eye(n + 1)[i]]) for i in range(n + 1) for s in (1, -1)]
    right = [-s * gap_at[i] for i in range(n + 1) for s in (1, -1)]
    rows += [np.concatenate([-move[n], none[0]]), *(np.concatenate([np.eye(2 * n)[n + i], none[0]]) for i in range(n))]
    right += [parts[n], *(0.0 if fixed[i] else parts[i] for i in range(n))]
    if mode == "one_step":
        rows += [np.concatenate([np.zeros(2 * n), e]) for e in np.eye(n + 1)]
        right += [0.0] * (n + 1)
    most, limit = np.asarray(rows), np.asarray(right)
    cost = np.concatenate([paid, np.full(n + 1, 0.0 if mode == "one_step" else penalty)])
    best = minimise(cost, most, limit)
    found = diagnosis(x, t, total, fixed)
    if best is None:
        return {"status": "infeasible", "mode": mode, "diagnosis": found, "target_reached": False}
    if mode != "one_step":
        slack = max(1e-12, abs(float(cost @ best)) * 1e-9)
        inside = np.vstack([most, cost]), np.append(limit, cost @ best + slack)
        best = nearest(np.hstack([gap_of, np.zeros((n + 1, n + 1))]), gap_at, *inside, best)
    buy, sell = best[:n] * total, best[n : 2 * n] * total
    both = np.minimum(buy, sell)  # trades that undo each other, free of cost
    buy, sell = buy - both, sell - both
    fee = float((buy + sell) @ rates)
    held, left = x + buy - sell, funds + float(sell.sum() - buy.sum()) - fee
    if left < -1e-6 * max(1.0, total) or abs(held.sum() + left + fee - total) > 1e-6 * max(1.0, total):
        raise RuntimeError("the plan doesn't conserve money")
    after = float(held.sum() + left)
    off = np.append(held, left) / after - goal
    return {
        "status": "ok",
        "mode": mode,
        "buy": buy,
        "sell": sell,
        "cost": fee,
        "holdings": held,
        "cash": max(0.0, left),
        "gap": off,
        "max_gap": float(np.abs(off).max()),
        "total_variation_gap": float(np.abs(off).sum() / 2),
        "target_reached": bool(np.abs(off).max() < 1e-6),
        "diagnosis": found,
        "payback": "no_expected_return_input" if improvement is None else "first_order_scenario" if improvement > 0 else "no_finite_positive_payback",
        "payback_years": fee / (improvement * total) if improvement and improvement > 0 else None,
    }


def diagnosis(current: np.ndarray, target: np.ndarray, total: float, fixed: np.ndarray) -> dict:
    """What can't be sold and is above its target, and the least new money that would dilute it; None if no money would."""
    above = [i for i in np.flatnonzero(fixed).tolist() if current[i] / total > target[i] + 1e-9]
    needs = [float(current[i] / target[i] - total) if target[i] > 0 else None for i in above]
    return {"obstacles": above, "needs": needs, "additional_funds": None if None in needs else max([0.0, *needs])}


def obstacles(holdings: DataFrame, *keys: str) -> DataFrame:
    """``keys``, n_obstacles, additional_funds: the same for many accounts. ``holdings`` has keys, amount, target and fixed; cash is a holding that isn't fixed."""
    total = holdings.groupBy(*keys).agg(F.sum("amount").alias("total"))
    above = F.col("fixed") & (F.col("amount") / F.col("total") > F.col("target") + 1e-9)
    need = F.when(F.col("target") > 0, F.col("amount") / F.col("target") - F.col("total"))
    each = holdings.join(total, list(keys)).withColumn("above", above).withColumn("need", need)
    never = F.bool_or(F.col("above") & F.col("need").isNull())
    return each.groupBy(*keys).agg(F.count_if("above").alias("n_obstacles"),
        F.when(~F.coalesce(never, F.lit(False)), F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("above"), F.col("need"))), F.lit(0.0)))).alias("additional_funds"))
