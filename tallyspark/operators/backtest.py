"""Weighted ledgers whose trades depend on what is held: one group of rows for each path, worked through in date order.

Returns, external flows, orders and target schedules are joined by path and date first, so that a path's days arrive as plain rows, and every
guard is counted before any path is worked through. A day: external flow, sale in proportion if cash is short, test of the trigger, trades,
returns, record. Costs are part of the return.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .returns import InputError, require

TRADES = "array<struct<reason:string,cost:double,notionals:array<double>>>"
LEDGER = f"path string, date date, value double, cash double, flow double, cost double, turnover double, r double, nav double, weights array<double>, trades {TRADES}"
CALENDAR = {"never": None, "monthly": "M", "quarterly": "Q", "yearly": "Y"}


@dataclass
class Rules:
    """How a path trades. ``rates`` is a cost for all assets or one for each; ``rebalance`` is never, monthly, quarterly or yearly, ``every`` takes its place with a
    number of steps (0: only the first), ``threshold`` is the relative distance of a weight from its target (absolute where that is 0). Positive flows are invested
    at once with ``flow_rule`` target and stay in cash with cash. ``orders`` tells whether the path follows given orders instead of rebalancing."""

    targets: dict[str, float]
    value: float = 100.0
    rates: float | dict[str, float] = 0.0
    rebalance: str = "never"
    every: int | None = None
    threshold: float | None = None
    cash_return: float = 0.0
    flow_rule: str = "target"
    initial: dict[str, float] = field(default_factory=dict)
    orders: bool = False

    def checked(self) -> Rules:
        for some in (self.targets, self.initial):
            w = np.asarray(list(some.values()), dtype=float)
            if len(w) and (not np.isfinite(w).all() or (w < 0).any() or w.sum() > 1 + 1e-9):
                raise InputError("weights must not be negative nor sum to more than 1")
        costs = np.atleast_1d(np.asarray(list(self.rates.values()) if isinstance(self.rates, dict) else self.rates, dtype=float))
        if not np.isfinite(costs).all() or (costs < 0).any() or (costs >= 1).any():
            raise InputError("costs are shares from 0 to below 1")
        if not np.isfinite(self.value) or self.value <= 0 or not np.isfinite(self.cash_return) or self.cash_return <= -1:
            raise InputError("an account begins with money, and cash can't lose all")
        if self.rebalance not in CALENDAR or self.flow_rule not in ("target", "cash") or (self.threshold is not None and not self.threshold > 0):
            raise InputError("unknown rule")
        if self.every is not None and (not isinstance(self.every, int) or self.every < 0):
            raise InputError("steps between trades are a whole number")
        return self


def traded(holdings: np.ndarray, cash: np.ndarray, target: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """What is left after costs, for many accounts (rows) that trade to ``target`` parts of it.

    net + sum rates |target net - holdings| = total is increasing and piecewise linear in net. Its kinks are holdings / target; the equation is solved
    on the piece that holds the total.
    """
    total = holdings.sum(axis=1) + cash
    kinks = np.divide(holdings, target, out=np.zeros_like(holdings), where=target > 0)
    knots = np.sort(np.column_stack((np.clip(kinks, 0, total[:, None]), np.zeros(len(total)), total)), axis=1)
    worth = knots + np.abs(knots[:, :, None] * target - holdings[:, None, :]) @ rates
    if (worth[:, 0] > total + 1e-12 * np.abs(total)).any():
        raise InputError("too little to pay for the trades")
    piece = np.clip((worth <= total[:, None]).sum(axis=1) - 1, 0, knots.shape[1] - 2)[:, None]
    (a, b), (low, high) = ([np.take_along_axis(x, piece + k, axis=1)[:, 0] for k in (0, 1)] for x in (knots, worth))
    return a + (total - low) * np.divide(b - a, high - low, out=np.zeros_like(a), where=high > low)


def rebalanced(holdings: np.ndarray, cash: float, target: np.ndarray, rates: float | np.ndarray) -> tuple[np.ndarray, float, float]:
    """(holdings, cash, cost) of one account after trading to ``target`` parts of what is left after costs."""
    costs = np.broadcast_to(np.asarray(rates, dtype=float), holdings.shape)
    net = float(traded(holdings[None, :], np.asarray([cash]), target, costs)[0])
    held = target * net
    return held, net - float(held.sum()), float(np.abs(held - holdings) @ costs)


class Account:
    """Holdings and cash of one path; each trade is noted with its reason."""

    def __init__(self, rules: Rules, assets: list[str]):
        parts = np.asarray([rules.initial.get(a, 0.0) for a in assets])
        self.rates = np.asarray([rules.rates.get(a, 0.0) if isinstance(rules.rates, dict) else rules.rates for a in assets], dtype=float)
        self.held = parts * rules.value
        self.cash = rules.value * (1 - parts.sum())
        self.trades: list[tuple[str, float, np.ndarray]] = []

    @property
    def total(self) -> float:
        return float(self.held.sum() + self.cash)

    def buy(self, change: np.ndarray, reason: str) -> None:
        fee = float(np.abs(change) @ self.rates)
        self.held = self.held + change
        self.cash -= change.sum() + fee
        self.trades.append((reason, fee, change))

    def to(self, target: np.ndarray, reason: str) -> None:
        net = float(traded(self.held[None, :], np.asarray([self.cash]), target, self.rates)[0])
        self.buy(target * net - self.held, reason)
        self.cash = net * (1 - target.sum())  # without what rounding leaves

    def cover(self) -> None:
        """Sell the same part of every holding until cash is no longer negative."""
        worth = float(self.held @ (1 - self.rates))
        if self.cash < 0:
            if worth < -self.cash * (1 - 1e-12):
                raise InputError("the withdrawal is larger than what is held")
            self.buy(-self.held * (-self.cash / worth), "withdrawal")
            self.cash = max(self.cash, 0.0)

    def order(self, change: np.ndarray) -> None:
        if (self.held + change < -1e-8).any() or self.cash - change.sum() - np.abs(change) @ self.rates < -1e-8:
            raise InputError("an order would leave short holdings or cash below zero")
        self.buy(change, "order")


def _walk(rows: pd.DataFrame, rules: Rules, assets: list[str]) -> pd.DataFrame:
    account, nav, out = Account(rules, assets), 1.0, []
    target = np.asarray([rules.targets.get(a, 0.0) for a in assets])
    dates = pd.to_datetime(rows["date"])
    code = CALENDAR[rules.rebalance]
    turn = dates.dt.to_period(code).ne(dates.dt.to_period(code).shift()).to_numpy() if code else np.zeros(len(rows), bool)
    for step, (date, r, flow, order, planned) in enumerate(zip(rows["date"], rows["r"], rows["flow"], rows["order"], rows["planned"])):
        account.trades = []
        opening = account.total + flow
        if opening <= 0:
            raise InputError("a flow exhausts the account")
        account.cash += flow
        account.cover()
        off = np.abs(account.held / account.total - target) / np.where(target > 0, target, 1.0)
        due = step == 0 or (step % rules.every == 0 if rules.every else turn[step] if rules.every is None else False)
        due = due or (rules.threshold is not None and bool((off > rules.threshold).any())) or (flow > 0 and rules.flow_rule == "target")
        if planned is not None:
            target, due = np.asarray(planned, dtype=float), True
        if due and (not rules.orders or step == 0):
            account.to(target, "initial" if rules.orders else "rebalance")
        if rules.orders and order is not None:
            account.order(np.asarray(order, dtype=float))
        account.held = account.held * (1 + np.asarray(r, dtype=float))
        account.cash *= 1 + rules.cash_return
        end = account.total
        nav *= end / opening
        moved = [{"reason": reason, "cost": fee, "notionals": change.tolist()} for reason, fee, change in account.trades]
        out.append((rows["path"].iloc[0], date, end, account.cash, flow, sum(t["cost"] for t in moved), sum(np.abs(t["notionals"]).sum() for t in moved), end / opening - 1, nav,
            (account.held / end).tolist(), moved))
    return pd.DataFrame(out, columns=["path", "date", "value", "cash", "flow", "cost", "turnover", "r", "nav", "weights", "trades"])


def days(panel: DataFrame, assets: list[str], flows: DataFrame | dict | None = None, orders: DataFrame | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """(path, date, r, flow, order, planned): a row for each day of a path, with arrays in the order of ``assets``. ``panel`` has path, date, asset and r; ``flows``
    date and amount (or a dict of them), ``orders`` date, asset and notional, ``schedule`` date, asset and w, each with path or for all paths. A missing or repeated cell, an amount that isn't
    finite, a total loss, an unknown asset, and what falls on a day that the panel doesn't have raise."""
    known = F.array(*map(F.lit, assets))

    def finite(c: str):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    def wide(df: DataFrame, value: str, keys: list[str], missing=None):
        cells = F.map_from_entries(F.collect_list(F.struct("asset", value)))
        once = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("asset").alias("kinds"), F.when(F.count("*") == F.countDistinct("asset"), cells).alias("cells"))
        at = F.transform(known, lambda a: F.coalesce(F.col("cells")[a], F.lit(missing).cast("double")))
        return once.select(*keys, (F.col("n") != F.col("kinds")).alias("twice"), at.alias(value))

    panel = panel.select("path", "date", "asset", F.col("r").cast("double").alias("r"))
    require(panel, no_return=finite("r"), total_loss=F.col("r") <= -1, unknown_asset=~F.array_contains(known, F.col("asset")))
    base = wide(panel, "r", ["path", "date"])
    require(base, repeated_cell=F.col("twice"), missing_cell=F.exists("r", lambda x: x.isNull()))
    base = base.drop("twice")

    if isinstance(flows, dict):
        flows = panel.sparkSession.createDataFrame([(str(d), float(x)) for d, x in flows.items()], "date string, amount double").withColumn("date", F.to_date("date")) if flows else None

    def attach(base: DataFrame, more: DataFrame | None, name: str) -> DataFrame:
        if more is None:
            return base.withColumn(name, F.lit(0.0) if name == "flow" else F.lit(None).cast("array<double>"))
        keys = [k for k in ("path", "date") if k in more.columns]
        if name == "flow":
            require(more, no_amount=finite("amount"))
            rows = more.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("double")).alias(name)).withColumn("twice", F.col("n") > 1).drop("n")
        else:
            value = "notional" if name == "order" else "w"
            require(more, no_amount=finite(value), unknown_asset=~F.array_contains(known, F.col("asset")))
            rows = wide(more, value, keys, 0.0).withColumnRenamed(value, name)
        require(rows, repeated=F.col("twice"))
        if not rows.join(base, keys, "left_anti").isEmpty():
            raise InputError(f"a {name} falls on a day that the panel doesn't have")
        joined = base.join(rows.drop("twice"), keys, "left")
        return joined.fillna(0.0, [name]) if name == "flow" else joined

    out = attach(attach(attach(base, flows, "flow"), orders, "order"), schedule, "planned")
    if schedule is not None:
        require(out.where("planned is not null"), weights=F.exists("planned", lambda w: w < 0) | (F.aggregate("planned", F.lit(0.0), lambda a, b: a + b) > 1 + 1e-9))
    return out


def ledgers(panel: DataFrame, rules: Rules | dict[str, Rules], flows: DataFrame | None = None, orders: DataFrame | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """A ledger for each path of ``panel``, by ``rules`` for all or for each path. Paths run in parallel, a path in one task."""
    every = {None: rules.checked()} if isinstance(rules, Rules) else {k: v.checked() for k, v in rules.items()}
    assets = sorted(set().union(*(v.targets for v in every.values())))
    if orders is not None and schedule is not None:
        raise InputError("orders and a schedule of targets exclude each other")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _walk(rows.sort_values("date"), every[None] if None in every else every[rows["path"].iloc[0]], assets)

    return days(panel, assets, flows, orders, schedule).groupBy("path").applyInPandas(run, LEDGER)


def backtest(panel: DataFrame, targets: dict[str, float], value: float = 100.0, rate: float | dict[str, float] = 0.0, rebalance: str = "never", every: int | None = None,
    threshold: float | None = None, flows: DataFrame | None = None, cash_return: float = 0.0, **more) -> DataFrame:
    """:func:`ledgers` by one set of rules, in plain columns."""
    return ledgers(panel, Rules(targets, value, rate, rebalance, every, threshold, cash_return, **more), flows).drop("weights", "trades")


def transactions(ledger: DataFrame, assets: list[str]) -> DataFrame:
    """(path, date, reason, cost, asset, notional) of every trade in a ledger."""
    each = ledger.select("path", "date", F.explode("trades").alias("t")).select("path", "date", "t.reason", "t.cost", F.posexplode("t.notionals").alias("k", "notional"))
    return each.select("path", "date", "reason", "cost", F.element_at(F.array(*map(F.lit, sorted(assets))), F.col("k") + 1).alias("asset"), "notional").where("notional <> 0")


def investor_flows(ledger: DataFrame, value: float) -> DataFrame:
    """(path, date, amount) as the investor sees them: what is paid in is negative, the last value is paid out. The opening stands a day before the first row."""
    ends = ledger.groupBy("path").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("value", "date").alias("value"))
    opening = ends.select("path", F.date_sub("first", 1).alias("date"), F.lit(-float(value)).alias("amount"))
    closing = ends.select("path", F.col("last").alias("date"), F.col("value").alias("amount"))
    return opening.unionByName(ledger.where("flow <> 0").select("path", "date", (-F.col("flow")).alias("amount"))).unionByName(closing)


def counterfactual(panel: DataFrame, rules: Rules, orders: DataFrame, flows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledgers, differences) of what was traded (A), of holding what was bought first (B) and of quarterly rebalancing (C), from the same start and flows.

    ``panel`` has date, asset and r. Holding leaves positive flows in cash. Two more ledgers without costs split the difference of A and B in what the trades brought
    and the drag of costs and their compounding.
    """
    plain = {**vars(rules), "rebalance": "never", "every": None, "threshold": None}
    free = {**plain, "rates": 0.0}
    paths = {
        "A_actual": Rules(**{**plain, "orders": True}),
        "B_hold": Rules(**{**plain, "flow_rule": "cash"}),
        "C_mechanical": Rules(**{**plain, "rebalance": "quarterly"}),
        "gross_actual": Rules(**{**free, "orders": True, "flow_rule": "target"}),
        "gross_hold": Rules(**{**free, "flow_rule": "cash"}),
    }
    told = panel.withColumn("path", F.explode(F.array(*map(F.lit, paths))))
    ledger = ledgers(told, paths, flows, orders)
    last = ledger.groupBy().agg(*(F.max_by(F.when(F.col("path") == p, F.col("value")), F.when(F.col("path") == p, F.col("date"))).alias(p) for p in paths))
    net, gross = F.col("A_actual") - F.col("B_hold"), F.col("gross_actual") - F.col("gross_hold")
    told = last.select(net.alias("a_minus_b"), (F.col("A_actual") - F.col("C_mechanical")).alias("a_minus_c"), (F.col("C_mechanical") - F.col("B_hold")).alias("c_minus_b"),
        gross.alias("gross"), net.alias("net"), (gross - net).alias("drag"))
    return ledger, told
