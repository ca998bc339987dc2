"""Dated cash needs of accounts under declared scenarios: what comes in, what is released or sold and when it settles, and the gaps that stay.

Scenarios are few and broadcast; everything else is joined by account. An event that isn't fully known changes no balance and marks its
scenario, an event that can't happen is blocked, one that settles after the horizon stays a receivable. Nothing is sold that wasn't planned.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .returns import InputError, by_date, require
from .returns import few as sized
from .scan import running
from .stage import written

EVENT = ["scenario", "account", "id", "kind", "date", "amount", "status", "reason"]


def net_factor(haircut: Column, extra: Column, fee: Column) -> Column:
    """What is left of a sale: (1 - min(1, haircut + extra)) (1 - fee)."""
    return (1 - F.least(F.lit(1.0), haircut + extra)) * (1 - fee)


def terms_reason(prefix: str = "") -> Column:
    """Why terms of liquidity don't tell what a sale brings: explicitly_not_sellable, or unknown_liquidity with the fields that miss."""
    c = lambda n: F.col(prefix + n)
    fields = ["can_sell", "haircut", "fee_rate", "settlement_days", "earliest_sale_date", "source"]
    missing = F.array_compact(F.array(*(F.when(c(n).isNull(), n) for n in fields), F.when(F.coalesce(c("settlement_day_basis") != "calendar", F.lit(True)), "settlement_day_basis"),
        F.when(F.coalesce(c("fee_timing") != "deduct_from_settlement_proceeds", F.lit(True)), "fee_timing")))
    return F.when(c("can_sell") == F.lit(False), "explicitly_not_sellable").when(F.size(missing) > 0, F.concat(F.lit("unknown_liquidity:"), F.array_join(missing, ",")))


def checked(flows: DataFrame, releases: DataFrame, sales: DataFrame, positions: DataFrame, liquidity: DataFrame, scenarios: DataFrame, start: dt.date, end: dt.date) -> None:
    """Guards: unique event ids, dates inside the horizon, releases within frozen cash, sales within positions that aren't cash, shares within 0 and 1."""
    if not 1 <= (end - start).days <= 3660:
        raise InputError("a horizon has 1 to 3660 days")
    a, b = F.lit(start), F.lit(end)
    share = lambda n: (F.col(n) < 0) | (F.col(n) > 1) | F.isnan(n)
    require(flows, kind=~F.col("kind").isin("income", "necessary_expense"), amount=F.coalesce(F.col("amount") < 0, F.lit(False)),
        date=F.coalesce((F.col("date") <= a) | (F.col("date") > b), F.lit(False)))
    require(scenarios, multiplier=share("income_multiplier"), haircut=share("additional_haircut"), delay=(F.col("settlement_delay_days") < 0) | (F.col("settlement_delay_days") > 3660),
        change=(F.col("income_multiplier") != 1) & F.col("income_change_from").isNull(), release=F.col("freeze_release_enabled").isNull())
    require(liquidity, haircut=F.coalesce(share("haircut"), F.lit(False)), fee=F.coalesce(share("fee_rate"), F.lit(False)), days=F.coalesce(F.col("settlement_days") < 0, F.lit(False)),
        earliest=F.coalesce(F.col("earliest_sale_date") <= a, F.lit(False)))
    ids = flows.select("account", "id").unionByName(releases.select("account", "id")).unionByName(sales.select("account", "id"))
    if not ids.groupBy("account", "id").count().where("count > 1").isEmpty():
        raise InputError("an event is entered twice")
    p = positions.select("account", "position_id", F.col("kind").alias("p_kind"), F.col("amount").alias("held"), F.coalesce("frozen_amount", F.lit(0.0)).alias("held_frozen"))
    freed = releases.groupBy("account", "position_id").agg(F.sum("amount").alias("v")).join(p, ["account", "position_id"], "left")
    require(freed, frozen_cash=(F.col("p_kind") != "cash") | (F.col("v") > F.col("held_frozen") + 1e-9))
    sold = sales.groupBy("account", "position_id").agg(F.sum("book_amount").alias("v")).join(p, ["account", "position_id"], "left")
    require(sold, book=(F.col("p_kind") == "cash") | (F.col("v") > F.col("held") + 1e-9))
    require(sales, trade_date=(F.col("trade_date") <= a) | (F.col("trade_date") > b))
    if not liquidity.join(p, ["account", "position_id"], "left_anti").isEmpty() or not liquidity.join(p.where("p_kind = 'cash'"), ["account", "position_id"], "left_semi").isEmpty():
        raise InputError("liquidity terms belong to positions that aren't cash")


def events(flows: DataFrame, releases: DataFrame, sales: DataFrame, liquidity: DataFrame, scenarios: DataFrame, end: dt.date, overrides: DataFrame | None = None) -> DataFrame:
    """Every event in every scenario, with status resolved, unknown, blocked or after_horizon and the reason. ``overrides`` (scenario, id, condition_met) take the place of a
    release's own condition."""
    few = sized(scenarios, "scenarios")
    late = lambda date: F.when(date > F.lit(end), "after_horizon").otherwise("resolved")
    income = F.col("kind") == "income"
    pressed = F.col("amount") * F.when(income & (F.col("date") >= F.col("income_change_from")), F.col("income_multiplier")).otherwise(1.0)
    gap = F.col("amount").isNull() | F.col("date").isNull()
    out = flows.crossJoin(few).select("scenario", "account", "id", F.when(income, "income").otherwise("expense").alias("kind"), "date", pressed.alias("amount"),
        F.when(gap, "unknown").otherwise(late(F.col("date"))).alias("status"), F.when(gap, "unknown_cashflow_amount_or_date").alias("reason"))

    told = releases.crossJoin(few)
    condition = F.col("condition_met")
    if overrides is not None:
        told = told.join(overrides.select("scenario", "id", F.col("condition_met").alias("__told"), F.lit(True).alias("__has")), ["scenario", "id"], "left")
        condition = F.when(F.col("__has"), F.col("__told")).otherwise(condition)
    off = ~F.col("freeze_release_enabled") | F.coalesce(~condition, F.lit(False))
    open_ = condition.isNull() | F.col("date").isNull()
    status = F.when(off, "blocked").when(open_, "unknown").otherwise(late(F.col("date")))
    reason = F.when(off, "release_disabled_or_condition_false").when(open_, "unknown_release_condition_or_date").when(F.col("date") > F.lit(end), "release_after_horizon")
    out = out.unionByName(told.select("scenario", "account", "id", F.lit("release").alias("kind"), "date", "amount", status.alias("status"), reason.alias("reason")))

    sold = sales.crossJoin(few).join(liquidity, ["account", "position_id"], "left").withColumn("why", terms_reason())
    require(sold.where("why IS NULL"), before_earliest=F.col("trade_date") < F.col("earliest_sale_date"))
    known = F.col("why").isNull()
    arrival = F.date_add("trade_date", (F.col("settlement_days") + F.col("settlement_delay_days")).cast("int"))
    net = F.col("book_amount") * net_factor(F.col("haircut"), F.col("additional_haircut"), F.col("fee_rate"))
    status = F.when(F.col("why") == "explicitly_not_sellable", "blocked").when(~known, "unknown").otherwise(late(arrival))
    reason = F.coalesce("why", F.when(arrival > F.lit(end), "not_available_within_horizon"))
    return out.unionByName(sold.select("scenario", "account", "id", F.lit("sale_net").alias("kind"), F.when(known, arrival).alias("date"), F.when(known, net).alias("amount"),
        status.alias("status"), reason.alias("reason")))


def ledger(happened: DataFrame, positions: DataFrame, scenarios: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """(scenario, account, date, income, expense, release, sale_net, balance, frozen, gap, without_sales) on every day of the horizon from the account's available cash."""
    cash = F.col("kind") == "cash"
    frozen = F.coalesce("frozen_amount", F.lit(0.0))
    opening = positions.groupBy("account").agg(F.coalesce(F.sum(F.when(cash, F.col("amount") - frozen)), F.lit(0.0)).alias("open_cash"),
        F.coalesce(F.sum(F.when(cash, frozen)), F.lit(0.0)).alias("open_frozen"))
    days = opening.crossJoin(sized(scenarios.select("scenario"), "scenarios")).withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end))))
    kinds = ("income", "expense", "release", "sale_net")
    daily = happened.where("status = 'resolved'").groupBy("scenario", "account", "date").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0)).alias(k) for k in kinds))
    rows = days.join(daily, ["scenario", "account", "date"], "left").fillna(0.0, list(kinds))
    own = F.col("income") + F.col("release") - F.col("expense")
    rows = running(rows, "scenario", "account", sums={"flown": own + F.col("sale_net"), "released": F.col("release"), "flown_alone": own})
    balance = F.col("open_cash") + F.col("flown")
    out = rows.withColumns({"balance": balance, "frozen": F.col("open_frozen") - F.col("released"), "without_sales": F.col("open_cash") + F.col("flown_alone")})
    return out.withColumn("gap", F.greatest(F.lit(0.0), -F.col("balance"))).drop("open_cash", "open_frozen", "flown", "released", "flown_alone")


def summary(daily: DataFrame, happened: DataFrame) -> DataFrame:
    """(scenario, account, first_gap, first_amount, peak, no_sale_peak, ending, ending_frozen, unknowns, blocked, status, complete_balance); the last is null while anything is
    unknown."""
    keys = ["scenario", "account"]
    short = F.col("gap") > 0
    out = daily.groupBy(*keys).agg(
        F.min(F.when(short, F.col("date"))).alias("first_gap"),
        F.min_by("gap", F.when(short, F.col("date"))).alias("first_amount"),
        F.max("gap").alias("peak"),
        F.greatest(F.lit(0.0), F.max(-F.col("without_sales"))).alias("no_sale_peak"),
        F.max_by("balance", "date").alias("ending"),
        F.max_by("frozen", "date").alias("ending_frozen"),
    )
    marks = happened.groupBy(*keys).agg(F.count_if(F.col("status") == "unknown").alias("unknowns"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    out = out.join(marks, keys, "left").fillna(0, ["unknowns", "blocked"])
    sure = F.col("unknowns") == 0
    return out.withColumns({"status": F.when(sure, "conditional_on_declared_inputs").otherwise("conditional_with_unknowns"), "complete_balance": F.when(sure, F.col("ending"))})


def liquidation(positions: DataFrame, sales: DataFrame, liquidity: DataFrame, scenarios: DataFrame, found: DataFrame) -> DataFrame:
    """For every position that isn't cash in every scenario: what all of it would bring, when at the earliest, whether that is in time for the first gap, and the book
    amount that alone would cover the peak need. A comparison position by position, not a plan."""
    planned = sales.groupBy("account", "position_id").agg(F.sum("book_amount").alias("planned"))
    rows = positions.where("kind <> 'cash'").select("account", "position_id", F.col("amount").alias("book")).join(planned, ["account", "position_id"], "left").join(liquidity,
        ["account", "position_id"], "left").crossJoin(sized(scenarios, "scenarios"))
    rows = rows.withColumn("reason", terms_reason()).join(found.select("scenario", "account", "first_gap", "peak"), ["scenario", "account"])
    known = F.col("reason").isNull()
    factor = F.when(known, net_factor(F.col("haircut"), F.col("additional_haircut"), F.col("fee_rate")))
    receipt = F.when(known, F.date_add("earliest_sale_date", (F.col("settlement_days") + F.col("settlement_delay_days")).cast("int")))
    left = F.col("book") - F.coalesce("planned", F.lit(0.0))
    need = F.when((F.col("peak") > 0) & (factor > 0) & (receipt <= F.col("first_gap")), F.col("peak") / factor)
    return rows.select("scenario", "account", "position_id", (F.col("book") * factor).alias("net_value"), left.alias("remaining"), receipt.alias("receipt"),
        (receipt <= F.col("first_gap")).alias("in_time"), need.alias("needed"), (need <= left).alias("sufficient"), F.coalesce("reason", F.lit("explicit_input_assumptions_only")).alias("reason"))


def cash_demand(positions: DataFrame, flows: DataFrame, releases: DataFrame, sales: DataFrame, liquidity: DataFrame, scenarios: DataFrame, start: dt.date, end: dt.date,
    overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, ledger, summary), see there."""
    checked(flows, releases, sales, positions, liquidity, scenarios, start, end)
    happened = written(events(flows, releases, sales, liquidity, scenarios, end, overrides), "events")  # read by the ledger and by the summary
    daily = ledger(happened, positions, scenarios, start, end)
    return happened, daily, summary(daily, happened)


def cash_fit(before: DataFrame, after: DataFrame, plans: DataFrame) -> DataFrame:
    """What planned outflows of a rebalancing add to two summaries, without and with them: (scenario, account, status, conflict, added). ``plans`` (account, id, can_trade)
    that may not be tradable make a scenario unknown, and what is unknown is no absence of conflict."""
    doubt = plans.groupBy("account").agg(F.count_if(~F.coalesce("can_trade", F.lit(False))).alias("doubts"))
    a = after.select("scenario", "account", F.col("peak").alias("peak_after"), F.col("unknowns").alias("u"))
    b = before.select("scenario", "account", F.col("peak").alias("peak_before"), F.col("unknowns").alias("ub"))
    rows = a.join(b, ["scenario", "account"]).join(doubt, "account", "left").fillna(0, ["doubts"])
    sure = (F.col("u") == 0) & (F.col("doubts") == 0)
    added = F.when(sure & (F.col("ub") == 0), F.greatest(F.lit(0.0), F.col("peak_after") - F.col("peak_before")))
    return rows.select("scenario", "account", F.when(sure, "conditional_on_declared_inputs").otherwise("unknown").alias("status"), F.when(sure, F.col("peak_after")).alias("conflict"),
        added.alias("added"))


def consecutive(periods: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end, follows): whether each period (date start, end) starts where the one before ended; the first one does."""
    told = periods.withColumn("date", F.col("start")).withColumn("before", F.lag("end").over(by_date(*keys)))
    return told.select(*keys, "start", "end", (F.col("before").isNull() | (F.col("before") == F.col("start"))).alias("follows"))
