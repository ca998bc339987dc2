"""Holdings, trades, cash and look-through."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .returns import by_date, few
from .scan import running


def buy_and_hold(returns: DataFrame, weights: DataFrame, value: float) -> DataFrame:
    """(date, value, r) of a portfolio bought once: weights drift by the product of returns, the rest is idle cash."""
    grown = running(returns.join(weights, "asset"), "asset", products={"g": 1 + F.col("r")}).withColumn("h", F.col("w") * value * F.col("g"))
    idle = weights.agg((value * (1 - F.sum("w"))).alias("idle"))
    path = grown.groupBy("date").agg(F.sum("h").alias("held")).join(F.broadcast(idle)).select("date", (F.col("held") + F.col("idle")).alias("value"))
    before = F.coalesce(F.lag("value").over(Window.orderBy("date")), F.lit(value))
    return path.withColumn("r", F.col("value") / before - 1)


def fixed_notional(periods: DataFrame, returns: DataFrame, trades: DataFrame, cash: float, *keys: str, bps: Column) -> DataFrame:
    """Equity per period of an account that trades fixed amounts: each trade grows by the returns from its period on.

    ``periods`` (ix), ``returns`` (ix, security, r), ``trades`` (ix, security, notional) and ``keys`` that are repeated for each, such as a fee rate. A row for each security and
    period, however many trades there are: with the growth of a security up to each period, a trade buys its amount over the growth before it in units, and what is held is all
    units so far times the growth. A return of -1 ends all units, so growth and units start again behind it. ``ix`` is a whole number."""
    spent = trades.groupBy(*keys, "security", "ix").agg(F.sum("notional").alias("notional"))
    rows = spent.select(*keys, "security").distinct().join(returns.select("security", "ix", "r"), "security").join(spent, [*keys, "security", "ix"], "full")
    on = [*keys, "security"]
    gone = F.coalesce(F.col("r") == -1, F.lit(False))
    rows = running(rows, *on, order="ix", sums={"ended": gone.cast("int")}).withColumn("ended", F.col("ended").cast("long"))
    rows = rows.withColumn("g", F.when(gone, 1.0).otherwise(F.coalesce(1 + F.col("r"), F.lit(1.0))))
    rows = running(rows, *on, "ended", order="ix", products={"grown": F.col("g")})
    bought = F.when(gone, 0.0).otherwise(F.coalesce("notional", F.lit(0.0))) * F.col("g") / F.col("grown")
    rows = running(rows, *on, "ended", order="ix", sums={"units": bought})
    held = rows.where("r IS NOT NULL").groupBy(*keys, "ix").agg(F.sum(F.col("units") * F.col("grown")).alias("held"))
    fees = trades.withColumn("fee", F.abs("notional") * bps / 10_000).groupBy(*keys, "ix").agg(F.sum("notional").alias("spent"), F.sum("fee").alias("fee"))
    w = Window.partitionBy(*keys).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    out = periods.join(held, [*keys, "ix"], "left").join(fees, [*keys, "ix"], "left").fillna(0.0, ["held", "spent", "fee"])
    gross = cash - F.sum("spent").over(w) + F.col("held")
    return out.select(*keys, "ix", gross.alias("gross"), (gross - F.sum("fee").over(w)).alias("net"))


def lookthrough(holdings: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """(leaf, kind, w, reason): what one fund holds through funds, see :func:`tallyspark.operators.exposure.paths`."""
    from .exposure import paths

    roots = holdings.sparkSession.createDataFrame([(root,)], "root string")
    return paths(holdings, roots, depth).select("leaf", "kind", "w", "reason")


def rollups(exposure: DataFrame) -> DataFrame:
    """(level, key, amount) sums by security, issuer, industry and kind of (security, issuer, industry, kind, amount) in one pass; what has no issuer or
    industry is its own bucket, and cash has neither."""
    e = exposure.withColumn("issuer", F.when(F.col("kind") != "cash", F.coalesce("issuer", F.lit("unmapped")))).withColumn("industry",
        F.when(F.col("kind") != "cash", F.coalesce("industry", F.lit("unmapped"))))
    cols = ["security", "issuer", "industry", "kind"]
    g = e.groupingSets([[c] for c in cols], *cols).agg(F.sum("amount").alias("amount"), *(F.grouping(c).alias(f"g_{c}") for c in cols))
    level = F.coalesce(*(F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in cols))
    key = F.coalesce(*(F.when(F.col(f"g_{c}") == 0, F.col(c)) for c in cols))
    return g.select(level.alias("level"), key.alias("key"), "amount").where("key is not null")


def rate_scenarios(exposure: DataFrame, shocks: DataFrame) -> DataFrame:
    """First-order change of bonds with a declared duration for each shock; null where nothing is eligible."""
    bond = F.col("kind") == "bond"
    able = bond & F.col("duration").isNotNull()
    return exposure.join(few(shocks, "shocks")).groupBy("scenario").agg(F.sum(F.when(able, -F.col("shock") * F.col("duration") * F.col("amount"))).alias("change"),
        F.sum(F.when(able, F.col("amount"))).alias("covered"), F.sum(F.when(bond & F.col("duration").isNull(), F.col("amount"))).alias("unestimated"))


def cash_ledger(flows: DataFrame, days: DataFrame, opening: Column, *keys: str) -> DataFrame:
    """Balance on every day of ``days`` (keys, date, with or without flows), and gap, what is missing to zero."""
    net = flows.groupBy(*keys, "date").agg(F.sum("amount").alias("net"))
    all_days = days.join(net, [*keys, "date"], "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    out = running(all_days, *keys, sums={"flown": F.col("net")}).withColumn("balance", opening + F.col("flown")).drop("flown")
    return out.withColumn("gap", F.greatest(F.lit(0.0), -F.col("balance")))


def first_gap(ledger: DataFrame, *keys: str) -> DataFrame:
    w = F.col("gap") > 0
    return ledger.groupBy(*keys).agg(F.min(F.when(w, F.col("date"))).alias("first_gap"), F.min_by("gap", F.when(w, F.col("date"))).alias("first_amount"), F.max("gap").alias("peak_gap"),
        F.max_by("balance", "date").alias("ending"))


def first_on_or_after(planned: DataFrame, dates: DataFrame, longest: int | None = None) -> DataFrame:
    """``planned`` (date) with used, the first of ``dates`` on or after it, at most ``longest`` days later. Each month is sorted by itself; what a month doesn't have is the first
    date of the months behind it, which are one row each."""
    both = planned.select("date", F.lit(1).alias("is_plan"), F.lit(None).cast("date").alias("d")).unionByName(dates.select("date", F.lit(0).alias("is_plan"), F.col("date").alias("d")))
    both = both.withColumn("month", F.trunc("date", "MM"))
    own = Window.partitionBy("month").orderBy(F.desc("date"), "is_plan").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("month").agg(F.min("d").alias("least")).select("month", F.last("least", ignorenulls=True).over(later).alias("next"))
    out = both.withColumn("own", F.last("d", ignorenulls=True).over(own)).where("is_plan = 1").join(carried, "month").select("date", F.coalesce("own", "next").alias("used"))
    return out if longest is None else out.withColumn("used", F.when(F.datediff("used", "date") <= longest, F.col("used")))


def last_on_or_before(planned: DataFrame, dates: DataFrame, oldest: int | None = None) -> DataFrame:
    """``planned`` (date) with used, the last of ``dates`` on or before it, at most ``oldest`` days earlier, in the same way."""
    both = planned.select("date", F.lit(1).alias("is_plan"), F.lit(None).cast("date").alias("d")).unionByName(dates.select("date", F.lit(0).alias("is_plan"), F.col("date").alias("d")))
    both = both.withColumn("month", F.trunc("date", "MM"))
    own = Window.partitionBy("month").orderBy("date", "is_plan").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("month").agg(F.max("d").alias("greatest")).select("month", F.last("greatest", ignorenulls=True).over(earlier).alias("before"))
    out = both.withColumn("own", F.last("d", ignorenulls=True).over(own)).where("is_plan = 1").join(carried, "month").select("date", F.coalesce("own", "before").alias("used"))
    return out if oldest is None else out.withColumn("used", F.when(F.datediff("date", "used") <= oldest, F.col("used")))


def xirr(flows: DataFrame, *keys: str) -> DataFrame:
    """Percent a year at which dated amounts (date, amount) are worth nothing, by 60 halvings on log(1 + r) in built-in expressions, which leave less than a double tells apart; null
    unless money first goes out and then comes back with one change of sign. Amounts are summed by day first, so a key's row holds as many pairs as the calendar has days, whatever the
    number of its flows."""
    own = Window.partitionBy(*keys)
    days = flows.groupBy(*keys, "date").agg(F.sum("amount").alias("amount")).where("amount <> 0")
    days = days.withColumn("t", F.datediff("date", F.min("date").over(own)) / 365.25).withColumn("turn", (F.signum("amount") != F.lag(F.signum("amount")).over(by_date(*keys))).cast("int"))
    one = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "amount"))).alias("f"), F.sum("turn").alias("turns"), F.min_by("amount", "date").alias("first"))
    npv = lambda y: F.aggregate("f", F.lit(0.0), lambda a, x: a + x["amount"] * F.exp(-y * x["t"]))
    start = F.struct(F.lit(-20.0).alias("lo"), F.lit(20.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        # The money goes out first, so the worth falls as the rate rises.
        return F.when(npv(mid) > 0, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    solvable = (F.col("turns") == 1) & (F.col("first") < 0) & (npv(F.lit(-20.0)) > 0) & (npv(F.lit(20.0)) < 0)
    return one.select(*keys, F.when(solvable, 100 * F.expm1(root)).alias("xirr"))


ROOTS = "status string, value double, roots array<double>"


#: Rates, as log(1 + r), whose worths are looked at for changes of sign; flows of a round of closing in, or of keys at once.
GRID, BESIDE = np.linspace(-20, 20, 2001), 1 << 18
_WIDE, _STEP = 64, 0.02
#: The grid as sums of coarse and fine rates; zero is a sum of zeros.
_COARSE, _FINE = np.arange(-16, 16) * _WIDE * _STEP, np.arange(_WIDE) * _STEP


def _worth(y: np.ndarray, times: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(-np.outer(y, times), -700, 700)) @ amounts


def _on_grid(times: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """Worths on the grid. exp(-(a + b) t) is a product, so the grid is one product of matrices of coarse and fine rates; what is nothing but rounding there is worked out by itself."""
    if times.max() > 34:  # beyond what a double holds at -20.48
        return _worth(GRID, times, amounts)
    coarse, fine = np.exp(-np.outer(_COARSE, times)), np.exp(-np.outer(times, _FINE))
    first = -1000 + 16 * _WIDE
    at = ((coarse * amounts) @ fine).ravel()[first : first + len(GRID)]
    scale = ((coarse * np.abs(amounts)) @ fine).ravel()[first : first + len(GRID)]
    near = np.flatnonzero(np.abs(at) <= 1e-10 * scale)
    at[near] = _worth(GRID[near], times, amounts)
    return at


def _closed_in(low: np.ndarray, high: np.ndarray, sign: np.ndarray, sizes: np.ndarray, times: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """Roots between ``low`` and ``high``, where the worth has ``sign`` at ``low``, by 60 halvings of all at once; each has ``sizes`` flows of ``times`` and ``amounts``."""
    starts = np.cumsum(sizes) - sizes
    for _ in range(60):
        mid = (low + high) / 2
        same = np.sign(np.add.reduceat(amounts * np.exp(np.clip(-np.repeat(mid, sizes) * times, -700, 700)), starts)) == sign
        low, high = np.where(same, mid, low), np.where(same, high, mid)
    return (low + high) / 2


def discount_roots_of(times: list[np.ndarray], amounts: list[np.ndarray]) -> list[tuple[str, list[float]]]:
    """(status, rates) of each list of dated amounts, at which they are worth nothing: changes of sign of their worth on a grid of log(1 + r) from -20 to 20, each closed in by
    halving. ok with one root, multiple_solutions with more, no_solution without."""
    exact: list[np.ndarray] = [GRID[:0]] * len(times)
    found: list[list[np.ndarray]] = [[] for _ in times]
    todo: list[tuple[int, float, float, float]] = []

    def close_in() -> None:
        if todo:
            of, low, high, sign = (np.asarray(x) for x in zip(*todo))
            roots = _closed_in(low, high, sign, np.asarray([len(times[k]) for k in of]), np.concatenate([times[k] for k in of]), np.concatenate([amounts[k] for k in of]))
            for k, root in zip(of, roots):
                found[k].append(root)
            todo.clear()

    waiting = 0
    for k, (t, a) in enumerate(zip(times, amounts)):
        if not len(t) or t.max() <= 0 or not ((a > 0).any() and (a < 0).any()):
            continue
        at = _on_grid(t, a)
        exact[k] = GRID[:-1][at[:-1] == 0]
        sign = np.sign(at)
        for i in np.flatnonzero((at[:-1] != 0) & (sign[:-1] != sign[1:])).tolist():
            todo.append((k, GRID[i], GRID[i + 1], sign[i]))
            waiting += len(t)
            if waiting >= BESIDE:
                close_in()
                waiting = 0
    close_in()
    out = []
    for e, f in zip(exact, found):
        roots = np.unique(np.round(np.concatenate([e, f]), 10)) if len(e) or f else GRID[:0]
        out.append(("ok" if len(roots) == 1 else "multiple_solutions" if len(roots) else "no_solution", np.expm1(roots).tolist()))
    return out


def discount_roots(times: np.ndarray, amounts: np.ndarray) -> tuple[str, list[float]]:
    """:func:`discount_roots_of` one list of dated amounts."""
    return discount_roots_of([times], [amounts])[0]


def xirr_roots(flows: DataFrame, *keys: str) -> DataFrame:
    """keys, status, value (where there is one root) and all roots of dated amounts (date, amount), as rates a year of 365.25 days. Amounts of a day are summed before they
    reach Python, a key in one row; rows without a date or an amount are not known."""
    own = Window.partitionBy(*keys)
    days = flows.groupBy(*keys, "date").agg(F.sum("amount").alias("amount")).withColumn("t", F.datediff("date", F.min("date").over(own)) / 365.25)
    one = days.groupBy(*keys).agg(F.collect_list(F.struct("t", "amount")).alias("f"))

    @F.arrow_udf(ROOTS)
    def solved(f: pa.Array) -> pa.Array:
        flows, sizes = f.flatten(), f.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        t, a = (flows.field(n).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for n in ("t", "amount"))
        ends = np.cumsum(sizes)
        some = [slice(end - n, end) for end, n in zip(ends.tolist(), sizes.tolist())]
        known = ~(np.isnan(t) | np.isnan(a))
        told = discount_roots_of([t[x][known[x]] for x in some], [a[x][known[x]] for x in some])
        each = [pa.array([status for status, _ in told], pa.string()), pa.array([r[0] if len(r) == 1 else None for _, r in told], pa.float64()), pa.array([r for _, r in told], pa.list_(pa.float64()))]
        return pa.StructArray.from_arrays(each, ["status", "value", "roots"])

    return one.withColumn("s", solved("f")).select(*keys, "s.status", "s.value", "s.roots")


def observed(obs: DataFrame, *keys: str) -> DataFrame:
    """Time-weighted return, profit and net flow of valuations (date, before, flow, after)."""
    w = by_date(*keys)
    r = obs.withColumn("r", F.col("before") / F.lag("after").over(w) - 1)
    return r.groupBy(*keys).agg((F.product(1 + F.coalesce("r", F.lit(0.0))) - 1).alias("twr"), F.sum("flow").alias("net_flow"), F.min_by("after", "date").alias("opening"),
        F.max_by("after", "date").alias("ending"), F.min_by("flow", "date").alias("first_flow")).select(
        *keys, "twr", (F.col("net_flow") - F.col("first_flow")).alias("net_flow"), "opening", "ending", (F.col("ending") - F.col("opening") - F.col("net_flow") + F.col("first_flow")).alias("profit")
    )


def brinson(segments: DataFrame) -> DataFrame:
    """Per period (segment, wp, wb, rp, rb): allocation, selection, interaction, portfolio and benchmark return."""
    total = segments.withColumn("b", F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy("period")))
    return total.groupBy("period").agg(
        F.sum((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("b"))).alias("allocation"),
        F.sum(F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        F.sum((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
        F.sum(F.col("wp") * F.col("rp")).alias("p"),
        F.sum(F.col("wb") * F.col("rb")).alias("b"),
    )


def brinson_linked(periods: DataFrame) -> DataFrame:
    """Effects over all periods by Carino's coefficients; they sum to the compounded excess, up to ``residual``."""
    k = lambda p, b: F.when(F.abs(p - b) <= 1e-10, 1 / (1 + b)).otherwise((F.log1p(p) - F.log1p(b)) / (p - b))
    whole = periods.agg(F.expm1(F.sum(F.log1p("p"))).alias("tp"), F.expm1(F.sum(F.log1p("b"))).alias("tb"))
    each = periods.join(F.broadcast(whole)).withColumn("c", k(F.col("p"), F.col("b")) / k(F.col("tp"), F.col("tb")))
    out = each.agg(*(F.sum(F.col("c") * F.col(n)).alias(n) for n in ("allocation", "selection", "interaction")), (F.first("tp") - F.first("tb")).alias("excess"))
    return out.withColumn("residual", F.col("excess") - F.col("allocation") - F.col("selection") - F.col("interaction"))


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 from the md5 of its parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap_rows(spark, n: int, paths: int, horizon: int, length: float, seed: int) -> DataFrame:
    """(path, step, row_ix) of a stationary bootstrap of ``n`` rows: a uniform start, restarts with chance 1 / ``length``, else the next row, around."""
    cells = spark.range(paths).select(F.col("id").cast("int").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    u = lambda tag: uniform(F.lit(str(seed)), F.col("path").cast("string"), F.col("step").cast("string"), F.lit(tag))
    start = F.when((F.col("step") == 0) | (u("restart") < 1 / length), F.col("step"))
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    jumps = cells.withColumn("begin", F.max(start).over(w)).withColumn("at", F.when(F.col("begin") == F.col("step"), F.floor(u("start") * n)))
    origin = F.last("at", ignorenulls=True).over(w)
    return jumps.select("path", "step", F.pmod(origin + F.col("step") - F.col("begin"), F.lit(n)).cast("int").alias("row_ix"))


def sign_changes(flows: DataFrame, *keys: str) -> DataFrame:
    """Per key: changes of sign of the daily sums, and whether they are conventional (out first, in last, one change)."""
    days = flows.groupBy(*keys, "date").agg(F.sum("amount").alias("a")).where("a <> 0")
    turns = days.withColumn("turn", (F.signum("a") != F.lag(F.signum("a")).over(by_date(*keys))).cast("int"))
    out = turns.groupBy(*keys).agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("changes"), F.min_by("a", "date").alias("first"), F.max_by("a", "date").alias("last"))
    return out.select(*keys, "changes", ((F.col("changes") == 1) & (F.col("first") < 0) & (F.col("last") > 0)).alias("conventional"))


def exit_cash(flows: DataFrame, *keys: str) -> DataFrame:
    """Per case of (date, kind, amount): what went out and came in, the multiple of both, changes of sign, and the rate of return where flows are conventional."""
    paid, got = F.sum(F.when(F.col("amount") < 0, -F.col("amount"))), F.sum(F.when(F.col("amount") > 0, F.col("amount")))
    totals = flows.groupBy(*keys).agg(paid.alias("paid"), got.alias("received"), F.sum("amount").alias("net"))
    out = totals.join(sign_changes(flows, *keys), list(keys)).join(xirr(flows, *keys), list(keys), "left")
    return out.select(*keys, "paid", "received", "net", (F.col("received") / F.nullif(F.col("paid"), F.lit(0.0))).alias("multiple"), "changes",
        F.when(F.col("conventional"), F.col("xirr")).alias("xirr"))


def under_scenarios(flows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Flows (owner, date, amount, kind) under each scenario (scenario, income_multiplier, change_from, extra_haircut, delay_days): income after a date is
    multiplied, sales lose the haircut and settle later. Scenarios are few and broadcast; nothing else is multiplied."""
    income, sale = F.col("kind") == "income", F.col("kind") == "sale"
    amount = F.when(income & (F.col("date") >= F.col("change_from")), F.col("amount") * F.col("income_multiplier")).when(sale,
        F.col("amount") * (1 - F.least(F.lit(1.0), F.col("extra_haircut")))).otherwise(F.col("amount"))
    date = F.when(sale, F.date_add("date", F.col("delay_days"))).otherwise(F.col("date"))
    return flows.crossJoin(few(scenarios, "scenarios")).select("scenario", "owner", "kind", date.alias("date"), amount.alias("amount"))


def scheduled(nav: DataFrame, planned: DataFrame, amount: float, fee: float, *, longest: int | None = None) -> DataFrame:
    """Contributions of ``amount`` on planned dates, each at the first nav on or after it: (date, paid, units, value) for each date with nav. The fee is part of the amount."""
    buys = first_on_or_after(planned, nav.select("date"), longest).where("used is not null").groupBy(F.col("used").alias("date")).agg(F.count("*").alias("k"))
    days = nav.join(buys, "date", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    units = F.sum(F.col("k") * amount / (1 + fee) / F.col("nav")).over(w)
    return days.select("date", (F.sum("k").over(w) * amount).alias("paid"), units.alias("units"), (units * F.col("nav")).alias("value"))


PLAN = "plan string, date date, units double, cash double, invested double, fees double, value double"


def contributions(days: DataFrame, plans: DataFrame) -> DataFrame:
    """A row for each plan and day: units, cash not yet reinvested, what was paid in and its fees, and value, in a path for each plan.

    ``days`` has date, nav, planned (how often something is due), cash_per_unit, split and reinvest_date, the last three null without an event; ``plans`` plan, mode (amount or
    units), distribution (reinvest or cash), amount and fee, which is part of what is paid. On a day the event comes first, for the units that were held, then what is due for
    reinvestment, then contributions. Plans are few, each is one task.
    """
    rows = days.crossJoin(few(plans, "plans"))

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("date")
        p = one.iloc[0]
        units = cash = paid = fees = 0.0
        due: dict = {}
        out = []
        for date, nav, planned, dividend, split, later in zip(one["date"], one["nav"], one["planned"], one["cash_per_unit"], one["split"], one["reinvest_date"]):
            got = units * (0.0 if pd.isna(dividend) else dividend)
            units *= 1.0 if pd.isna(split) else split
            cash += got
            if got and p["distribution"] == "reinvest":
                at = date if pd.isna(later) else later
                due[at] = due.get(at, 0.0) + got
            again = due.pop(date, 0.0)
            units, cash = units + again / nav, cash - again
            for _ in range(int(planned)):
                gross = p["amount"] if p["mode"] == "amount" else p["amount"] * nav * (1 + p["fee"])
                net = gross / (1 + p["fee"])
                units, paid, fees = units + net / nav, paid + gross, fees + gross - net
            out.append((p["plan"], date, units, cash, paid, fees, units * nav + cash))
        return pd.DataFrame(out, columns=["plan", "date", "units", "cash", "invested", "fees", "value"])

    return rows.groupBy("plan").applyInPandas(run, PLAN)


def notional_status(holdings: DataFrame, returns: DataFrame, trades: DataFrame, cost_known: Column, *keys: str) -> DataFrame:
    """(keys, status) of accounts that trade fixed amounts: blocked_or_unknown if a trade can't or may not be done, unknown if a return of a held security misses, unknown_cost
    without a cost, else conditional_on_declared_inputs. ``holdings`` has keys, ix and security of what is held in a period, ``trades`` keys and can_trade. Only the last has figures."""
    doubt = trades.groupBy(*keys).agg(F.count_if(~F.coalesce("can_trade", F.lit(False))).alias("doubts"))
    gaps = holdings.join(returns, [*keys, "ix", "security"], "left").groupBy(*keys).agg(F.count_if(F.col("r").isNull()).alias("gaps"))
    out = holdings.select(*keys).distinct().join(doubt, list(keys), "left").join(gaps, list(keys), "left").fillna(0, ["doubts", "gaps"])
    status = F.when(F.col("doubts") > 0, "blocked_or_unknown").when(F.col("gaps") > 0, "unknown").when(cost_known, "conditional_on_declared_inputs").otherwise("unknown_cost")
    return out.select(*keys, status.alias("status"))


def net_drawdown(path: DataFrame, opening: float, *keys: str) -> DataFrame:
    """(keys, max_drawdown) of net equity (keys, ix, net) from the opening amount on."""
    high = F.greatest(F.lit(float(opening)), F.max("net").over(Window.partitionBy(*keys).orderBy("ix")))
    return path.withColumn("fall", 1 - F.col("net") / high).groupBy(*keys).agg(F.max("fall").alias("max_drawdown"))


def compared_paths(path: DataFrame, reference: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(field, missing, extra, largest, agrees) of two paths (date and the same numbers): dates that a side lacks, the largest difference of each number."""
    fields = [c for c in path.columns if c != "date"]
    side = lambda df, tag: df.select("date", *(F.col(f).alias(f"{tag}_{f}") for f in fields), F.lit(True).alias(tag))
    joined = side(path, "a").join(side(reference, "b"), "date", "full")
    sums = joined.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"), *(F.max(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}"))).alias(f) for f in fields))
    each = sums.select("missing", "extra", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("largest")) for f in fields))).alias("s")).select("s.field", "missing",
        "extra", "s.largest")
    return each.withColumn("agrees", (F.col("missing") == 0) & (F.col("extra") == 0) & F.coalesce(F.col("largest") <= tolerance, F.lit(False)))
