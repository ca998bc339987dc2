import datetime as dt

import numpy as np
import pytest

from tallyspark import functions
from tallyspark.operators import backtest, demand, exposure, ledgers, migration
from tallyspark.operators.returns import InputError

DAY = dt.date(2024, 1, 1)


def panel(spark, values, path="p"):
    rows = [(path, DAY + dt.timedelta(days=k), a, float(r)) for k, row in enumerate(values) for a, r in zip("ab", row)]
    return spark.createDataFrame(rows, "path string, date date, asset string, r double")


def amounts(spark, some):
    return spark.createDataFrame([(DAY + dt.timedelta(days=k), float(a)) for k, a in some], "date date, amount double")


FLAT = [(0.0, 0.0)] * 4


def test_flows_on_unknown_days_raise(spark):
    with pytest.raises(InputError):
        backtest.backtest(panel(spark, FLAT), {"a": 0.5, "b": 0.5}, flows=amounts(spark, [(9, -40)]))
    with pytest.raises(InputError):
        backtest.backtest(panel(spark, FLAT), {"a": 0.5, "b": 0.5}, flows=amounts(spark, [(1, 5), (1, 5)]))


def test_missing_and_repeated_cells_raise(spark):
    p = panel(spark, FLAT)
    for bad in (p.where("NOT (asset = 'b' AND date = '2024-01-02')"), p.union(p.limit(1)), p.selectExpr("path", "date", "asset", "CASE WHEN asset = 'a' THEN -1D ELSE r END AS r")):
        with pytest.raises(InputError):
            backtest.backtest(bad, {"a": 0.5, "b": 0.5})


def test_withdrawals_are_paid_for(spark):
    got = backtest.backtest(panel(spark, FLAT), {"a": 0.5, "b": 0.5}, rate=0.01, flows=amounts(spark, [(2, -10)])).orderBy("date").collect()
    assert got[0]["cost"] == pytest.approx(100 / 1.01 * 0.01) and got[2]["cost"] == pytest.approx(10 / 0.99 * 0.01)
    assert got[2]["value"] == pytest.approx(got[1]["value"] - 10 / 0.99) and got[2]["cash"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(Exception, match="exhausts|larger"):
        backtest.backtest(panel(spark, FLAT), {"a": 0.5, "b": 0.5}, flows=amounts(spark, [(2, -200)])).collect()


def test_flow_rule(spark):
    p, flows = panel(spark, FLAT), amounts(spark, [(2, 50)])
    invested = backtest.backtest(p, {"a": 0.5, "b": 0.5}, flows=flows).orderBy("date").collect()
    kept = backtest.backtest(p, {"a": 0.5, "b": 0.5}, flows=flows, flow_rule="cash").orderBy("date").collect()
    assert invested[3]["cash"] == pytest.approx(0, abs=1e-9) and kept[3]["cash"] == pytest.approx(50)
    assert invested[3]["nav"] == pytest.approx(1) and kept[3]["nav"] == pytest.approx(1)


def test_orders_and_fees_of_their_own(spark):
    orders = spark.createDataFrame([(DAY + dt.timedelta(days=1), "a", -10.0), (DAY + dt.timedelta(days=1), "b", 5.0)], "date date, asset string, notional double")
    rules = backtest.Rules({"a": 0.5, "b": 0.5}, rates={"a": 0.01, "b": 0.0}, orders=True)
    ledger = backtest.ledgers(panel(spark, FLAT), rules, orders=orders)
    rows = ledger.orderBy("date").collect()
    assert rows[1]["cost"] == pytest.approx(0.1) and rows[1]["cash"] == pytest.approx(10 - 5 - 0.1, abs=1e-9) and rows[2]["cost"] == 0
    traded = {(r["reason"], r["asset"]): r["notional"] for r in backtest.transactions(ledger, ["a", "b"]).collect()}
    assert traded["order", "a"] == -10 and traded["order", "b"] == 5 and traded["initial", "a"] > 0
    short = orders.selectExpr("date", "asset", "notional * 100 AS notional")
    with pytest.raises(Exception, match="short"):
        backtest.ledgers(panel(spark, FLAT), rules, orders=short).collect()


def test_counterfactual_without_costs_has_no_drag(spark):
    values = [(0.01, -0.02), (0.03, 0.0), (-0.01, 0.02), (0.0, 0.01)]
    orders = spark.createDataFrame([(DAY + dt.timedelta(days=1), "a", -10.0), (DAY + dt.timedelta(days=1), "b", 10.0)], "date date, asset string, notional double")
    _, told = backtest.counterfactual(panel(spark, values).drop("path"), backtest.Rules({"a": 0.5, "b": 0.5}), orders)
    row = told.first()
    assert row["drag"] == pytest.approx(0, abs=1e-9) and row["net"] == pytest.approx(row["a_minus_b"])
    assert row["a_minus_b"] == pytest.approx(10 * (1.0 * 1.02 * 1.01 - 1.03 * 0.99))


def test_several_rates_of_return():
    status, roots = ledgers.discount_roots(np.asarray([0.0, 1.0, 2.0]), np.asarray([-100.0, 230.0, -132.0]))
    assert status == "multiple_solutions" and roots == pytest.approx([0.1, 0.2])
    assert ledgers.discount_roots(np.asarray([0.0, 1.0]), np.asarray([-100.0, 110.0]))[1] == pytest.approx([0.1])
    assert ledgers.discount_roots(np.asarray([0.0, 1.0]), np.asarray([100.0, 110.0])) == ("no_solution", [])


def test_roots_of_many_owners_at_once(spark):
    rng = np.random.default_rng(3)
    times = [np.arange(n) * 0.25 for n in rng.integers(0, 20, 200)] + [np.asarray([0.0, 20.0, 60.0])]
    amounts = [rng.normal(0, 1000, len(t)) for t in times[:-1]] + [np.asarray([-1.0, 3.0, -1.0])]
    for t, a, (status, roots) in zip(times, amounts, ledgers.discount_roots_of(times, amounts)):
        at = ledgers._worth(ledgers.GRID, t, a)
        able = len(t) > 1 and (a > 0).any() and (a < 0).any()
        assert len(roots) == (np.sign(at[:-1]) != np.sign(at[1:])).sum() * able and (status == "ok") == (len(roots) == 1)
        assert all(abs(np.exp(-np.log1p(x) * t) @ a) <= 1e-6 * (np.exp(-np.log1p(x) * t) @ abs(a)) for x in roots)


def test_amounts_that_are_not_known_make_no_roots(spark):
    day = dt.date(2020, 1, 1)
    rows = [("a", day, -100.0), ("a", day.replace(month=3), None), ("a", day.replace(year=2021), 120.0), ("b", day, None)]
    got = {r["k"]: r for r in ledgers.xirr_roots(spark.createDataFrame(rows, "k string, date date, amount double"), "k").collect()}
    assert got["a"]["status"] == "ok" and got["a"]["value"] == pytest.approx(0.2, abs=1e-3) and got["b"]["status"] == "no_solution"


def test_a_rate_takes_few_steps(spark, monkeypatch):
    rng, calls, exp = np.random.default_rng(4), [], np.exp
    monkeypatch.setattr(functions.np, "exp", lambda x: calls.append(1) or exp(x))
    for n in (1, 2, 12, 400):
        days = np.sort(rng.choice(2000, n + 1, replace=False))
        amounts = np.append(-rng.uniform(1, 1000, n), 5000.0 * n)
        calls.clear()
        rate = functions.rate_of_return(days, amounts)
        assert len(calls) <= 20
        t = (days - days[0]) / 365.25
        assert exp(-np.log1p(rate / 100) * t) @ amounts == pytest.approx(0, abs=1e-7 * n)


EDGE = "node string, child string, kind string, weight double"


def test_paths_stop_for_reasons(spark):
    edges = spark.createDataFrame([("f", "g", "fund", 0.5), ("g", "f", "fund", 0.5), ("g", "s", "stock", 0.4), ("f", "h", "fund", 0.2), ("f", "t", "bond", 0.3)], EDGE)
    got = {(r["leaf"], r["reason"]): r["w"] for r in exposure.paths(edges, spark.createDataFrame([("f",)], "root string")).collect()}
    assert got == pytest.approx({("t", None): 0.3, ("s", None): 0.2, ("unknown", "cycle"): 0.25, ("unknown", "missing_child"): 0.2, ("unknown", "undisclosed"): 0.05})
    assert exposure.paths(edges, spark.createDataFrame([("f",)], "root string"), depth=1).where("reason = 'depth_limit'").count() == 2
    with pytest.raises(InputError):
        exposure.paths(edges.union(spark.createDataFrame([("f", "x", "stock", 0.5)], EDGE)), spark.createDataFrame([("f",)], "root string"))


POSITION = "position_id string, economic_lot_id string, kind string, amount double, frozen_amount double, node string, security string"


def test_exposure_conserves_amounts(spark):
    positions = spark.createDataFrame([("1", "l1", "fund", 100.0, None, "f", None), ("2", "l2", "cash", 50.0, 20.0, None, "cny"), ("3", "l3", "bond", 30.0, None, None, "b"),
        ("4", "l4", "fund", 10.0, None, "gone", None)], POSITION)
    edges = spark.createDataFrame([("f", "s", "stock", 0.6), ("f", "cny", "cash", 0.1), ("f", "z", "stock", 0.2)], EDGE)
    master = spark.createDataFrame([("s", "stock", "i", "x", None, "list"), ("cny", "cash", None, None, None, "list"), ("b", "bond", None, None, 4.0, "list"),
        ("z", "stock", "i", "x", None, "")], "security string, kind string, issuer string, industry string, duration double, source string")
    known, unknown, cash = exposure.account_exposure(positions, edges, master)
    assert {(r["security"], r["origin"]): round(r["amount"], 6) for r in known.collect()} == {("s", "fund_disclosure"): 60.0, ("cny", "fund_disclosure"): 10.0,
        ("cny", "direct_account"): 50.0, ("b", "direct_account"): 30.0}
    assert {r["reason"]: round(r["amount"], 6) for r in unknown.collect()} == {"missing_security_identity_or_kind_evidence": 20.0, "undisclosed": 10.0, "missing_fund_disclosure": 10.0}
    row = cash.first()
    assert (row["available"], row["frozen"], round(row["fund_cash"], 6)) == (30.0, 20.0, 10.0)
    with pytest.raises(InputError):
        exposure.account_exposure(positions.union(positions.limit(1)), edges, master)
    with pytest.raises(InputError):
        exposure.account_exposure(positions, edges, master.selectExpr("security", "CASE WHEN security = 'b' THEN 'stock' ELSE kind END AS kind", "issuer", "industry", "duration", "source"))


def inputs(spark, condition=True, fee=0.01):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = lambda k: DAY + dt.timedelta(days=k)
    return {
        "positions": one([("x", "c", "cash", 100.0, 40.0), ("x", "s", "stock", 200.0, None)], "account string, position_id string, kind string, amount double, frozen_amount double"),
        "flows": one([("x", "i", "income", d(5), 30.0), ("x", "e", "necessary_expense", d(3), 150.0)], "account string, id string, kind string, date date, amount double"),
        "releases": one([("x", "r", "c", 40.0, d(2), condition)], "account string, id string, position_id string, amount double, date date, condition_met boolean"),
        "sales": one([("x", "q", "s", 100.0, d(4))], "account string, id string, position_id string, book_amount double, trade_date date"),
        "liquidity": one([("x", "s", True, 0.1, fee, "deduct_from_settlement_proceeds", 2, "calendar", d(1), "terms")],
            "account string, position_id string, can_sell boolean, haircut double, fee_rate double, fee_timing string, settlement_days int, settlement_day_basis string, earliest_sale_date date, source string"),
        "scenarios": one([("n", 1.0, None, 0.0, 0, True), ("s", 0.5, d(1), 0.2, 30, False)],
            "scenario string, income_multiplier double, income_change_from date, additional_haircut double, settlement_delay_days int, freeze_release_enabled boolean"),
    }


def test_cash_demand_by_hand(spark):
    i, end = inputs(spark), DAY + dt.timedelta(days=20)
    events, daily, found = demand.cash_demand(**i, start=DAY, end=end)
    got = {r["scenario"]: r for r in found.collect()}
    net = 100 * 0.9 * 0.99
    assert got["n"]["first_gap"] == DAY + dt.timedelta(days=3) and got["n"]["peak"] == pytest.approx(50) and got["n"]["ending"] == pytest.approx(-50 + 30 + net)
    assert got["n"]["no_sale_peak"] == pytest.approx(50) and got["n"]["ending_frozen"] == 0 and got["n"]["status"] == "conditional_on_declared_inputs"
    assert got["s"]["peak"] == pytest.approx(90) and got["s"]["ending"] == pytest.approx(-75) and got["s"]["blocked"] == 1 and got["s"]["ending_frozen"] == 40
    assert {(r["scenario"], r["id"]): r["status"] for r in events.collect()}["s", "q"] == "after_horizon"
    assert daily.count() == 2 * 21
    compared = {r["scenario"]: r for r in demand.liquidation(i["positions"], i["sales"], i["liquidity"], i["scenarios"], found).collect()}
    assert compared["n"]["in_time"] and compared["n"]["needed"] == pytest.approx(50 / (0.9 * 0.99)) and compared["n"]["sufficient"] and compared["n"]["remaining"] == 100
    assert not compared["s"]["in_time"] and compared["s"]["needed"] is None


def test_unknown_terms_stay_unknown(spark):
    _, _, found = demand.cash_demand(**inputs(spark, condition=None, fee=None), start=DAY, end=DAY + dt.timedelta(days=20))
    row = found.where("scenario = 'n'").first()
    assert row["unknowns"] == 2 and row["complete_balance"] is None and row["status"] == "conditional_with_unknowns"
    fit = demand.cash_fit(found, found, spark.createDataFrame([("x", "p", None)], "account string, id string, can_trade boolean"))
    assert {r["status"] for r in fit.collect()} == {"unknown"} and fit.where("conflict IS NOT NULL").count() == 0


def test_demand_guards(spark):
    i = inputs(spark)
    for name, change in (("flows", "date_add(date, 400) AS date"), ("sales", "book_amount * 9 AS book_amount"), ("releases", "amount * 2 AS amount")):
        keep = [c for c in i[name].columns if not change.endswith(f" {c}")]
        with pytest.raises(InputError):
            demand.cash_demand(**(i | {name: i[name].selectExpr(*keep, change).select(*i[name].columns)}), start=DAY, end=DAY + dt.timedelta(days=20))


def test_migration_plans():
    now, goal = np.asarray([90.0, 10.0, 0.0]), np.asarray([0.4, 0.4, 0.2])
    one = migration.plan(now, goal, cash=0.0, costs=np.asarray([0.01, 0.02, 0.0]), mode="one_step")
    assert one["target_reached"] and one["holdings"].sum() + one["cash"] + one["cost"] == pytest.approx(100)
    assert one["cost"] == pytest.approx(0.01 * one["sell"][0] + 0.02 * one["buy"][1])
    kept = migration.plan(now, goal, cash=20.0, costs=0.001, mode="buy_only")
    assert kept["status"] == "ok" and not kept["target_reached"] and (kept["sell"] == 0).all() and kept["diagnosis"]["obstacles"] == [0]
    assert kept["diagnosis"]["additional_funds"] == pytest.approx(90 / 0.4 - 120)
    assert kept["buy"][1] + kept["buy"][2] == pytest.approx(20 / 1.001, rel=1e-5)
    assert migration.plan(now, goal, locked=(0,), mode="one_step")["status"] == "infeasible"
    free = migration.plan(now, goal, costs=0.0, mode="minimum_trade", improvement=0.01)
    assert free["target_reached"] and free["payback_years"] == 0 and np.minimum(free["buy"], free["sell"]).max() < 1e-9
