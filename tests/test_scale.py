"""What is cut into blocks, rounds and ranges gives what one pass over the whole gives."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import budget, evaluation, exposure, factors, ledgers, moments, risk, scan, select, solve
from tallyspark.operators.returns import InputError

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


# Running figures


def long_series(rng, n=700):
    return [(name, day(k), rng.choice([0.0, 0.01, -0.02, 0.03, -0.5])) for name in ("a", None) for k in rng.sample(range(1500), n)]


def test_running_over_many_blocks(spark):
    rows = long_series(random.Random(1))
    df = spark.createDataFrame(rows, "name string, date date, r double")
    got = scan.running(df, "name", sums={"total": F.col("r")}, products={"grown": 1 + F.col("r")})
    assert df.select(scan.block_of(df, "date")).distinct().count() > 40
    for name in ("a", None):
        mine = sorted((d, r) for n, d, r in rows if n == name)
        have = {r["date"]: (r["total"], r["grown"]) for r in got.where(F.col("name").eqNullSafe(F.lit(name))).collect()}
        assert len(have) == len(mine)
        total, grown = 0.0, 1.0
        for d, r in mine:
            total, grown = total + r, grown * (1 + r)
            assert have[d] == pytest.approx((total, grown))


def test_drawdown_over_many_blocks(spark):
    rows = long_series(random.Random(2))
    got = risk.drawdown_path(spark.createDataFrame(rows, "name string, date date, r double"), "name")
    for name in ("a", None):
        mine = sorted((d, r) for n, d, r in rows if n == name)
        have = {r["date"]: (r["nav"], r["underwater"]) for r in got.where(F.col("name").eqNullSafe(F.lit(name))).collect()}
        nav = high = 1.0
        for d, r in mine:
            nav *= 1 + r
            high = max(high, nav)
            assert have[d] == pytest.approx((nav, 1 - nav / high), abs=1e-12)


def test_whole_numbers_and_instants_are_blocks_too(spark):
    for kind, values in (("int", list(range(0, 5000, 7))), ("timestamp", [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=11 * k) for k in range(700)])):
        df = spark.createDataFrame([(v, 1.0) for v in values], f"at {kind}, x double")
        got = scan.running(df, order="at", sums={"n": F.col("x")}).orderBy("at").collect()
        assert [r["n"] for r in got] == list(range(1, len(values) + 1)) and df.select(scan.block_of(df, "at")).distinct().count() > 4


# Order statistics, tails, ranks


def test_order_statistics_of_one_group_in_many_tasks(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1e-6), rng.gauss(0, 1e6), 0.25, -3.0]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(16)
    ranks = [1, 2, 777, 2000, 2001, 3999, 4000]
    got = select.order_statistics(df, "x", {f"k{k}": F.lit(k) for k in (*ranks, 0, 4001)}).first()
    values.sort()
    assert got["n"] == 4000 and [got[f"k{k}"] for k in ranks] == [values[k - 1] for k in ranks] and got["k0"] is None and got["k4001"] is None


def test_quantiles_by_key(spark):
    rng = random.Random(4)
    rows = [(name, rng.choice([1.0, 2.0, rng.random()])) for name in ("a", "b", None) for _ in range(101)] + [("one", 5.0)]
    got = {r["name"]: r for r in select.quantiles(spark.createDataFrame(rows, "name string, x double"), "x", {"p05": 0.05, "half": 0.5, "p99": 0.99}, "name").collect()}
    for name in ("a", "b", None, "one"):
        mine = [x for n, x in rows if n == name]
        assert [got[name][c] for c in ("p05", "half", "p99")] == pytest.approx(np.quantile(mine, [0.05, 0.5, 0.99]).tolist()) and got[name]["n"] == len(mine)


def test_tail_of_one_group_in_many_tasks(spark):
    rng = np.random.default_rng(5)
    r = np.round(rng.normal(0, 0.02, 3000), 3)  # many ties at the boundary
    row = risk.expected_shortfall(spark.createDataFrame([(day(k), "a", float(x)) for k, x in enumerate(r)], "date date, asset string, r double").repartition(12), "asset", alpha=0.973).first()
    loss = np.sort(-r)[::-1]
    part = np.clip((1 - 0.973) * len(r) - np.arange(len(r)), 0, 1)
    assert row["es"] == pytest.approx(loss @ part / part.sum()) and row["var"] == pytest.approx(np.quantile(loss, 0.973)) and row["status"] == "ok"


def test_ranks_of_one_cross_section(spark):
    rng = random.Random(6)
    rows = [("d", f"s{k}", rng.choice([0.5, 0.5, 0.5, rng.random()]), rng.random()) for k in range(900)]
    panel = spark.createDataFrame(rows, "signal_date string, security string, factor double, fwd double").repartition(9)
    narrow, wide = (factors.information(panel, 5, wide=w).first().asDict() for w in (False, True))
    assert wide == pytest.approx(narrow)
    got = {r["security"]: r["rank"] for r in select.average_ranks(panel, "factor", "rank").collect()}
    order = sorted(x for _, _, x, _ in rows)
    assert got == {s: np.mean([k + 1 for k, y in enumerate(order) if y == x]) if order.count(x) < 5 else order.index(x) + (order.count(x) + 1) / 2 for _, s, x, _ in rows}


def test_null_values_have_no_rank(spark):
    got = select.average_ranks(spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id int, x double"), "x", "rank").collect()
    assert {r["id"]: r["rank"] for r in got} == {1: 2.0, 2: None, 3: 1.0}


# Accounts


def held_by_steps(periods, returns, trades, cash, bps):
    held, spent, fees, out = {}, 0.0, 0.0, {}
    for ix in periods:
        for i, s, n in trades:
            if i == ix:
                held[s] = held.get(s, 0.0) + n
                spent, fees = spent + n, fees + abs(n) * bps / 10_000
        for s in held:
            held[s] *= 1 + returns[ix, s]
        out[ix] = (cash - spent + sum(held.values()), cash - spent + sum(held.values()) - fees)
    return out


def test_account_of_many_periods(spark):
    rng = random.Random(7)
    periods, names = list(range(2500)), ("a", "b")
    returns = {(ix, s): rng.choice([0.01, -0.01, 0.002, -1.0 if ix in (500, 501, 1300) and s == "a" else 0.0]) for ix in periods for s in names}
    trades = [(rng.choice(periods), rng.choice(names), rng.choice([5.0, -2.0, 7.0])) for _ in range(300)] + [(500, "a", 9.0), (10, "b", 3.0), (10, "b", 3.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = ledgers.fixed_notional(frame([(p,) for p in periods], "ix int"), frame([(*k, r) for k, r in returns.items()], "ix int, security string, r double"),
        frame(trades, "ix int, security string, notional double"), 1000.0, bps=F.lit(20.0))
    want = held_by_steps(periods, returns, trades, 1000.0, 20)
    rows = got.collect()
    assert len(rows) == len(periods)
    for r in rows:
        assert (r["gross"], r["net"]) == pytest.approx(want[r["ix"]], rel=1e-9, abs=1e-7)


def test_rate_of_an_owner_with_a_million_flows(spark):
    flows = spark.range(1_000_000).select(F.lit("a").alias("owner"), F.date_add(F.lit(DAY), (F.col("id") % 3000).cast("int")).alias("date"), F.lit(-1.0).alias("amount"))
    end = spark.createDataFrame([("a", day(4000), 1_500_000.0), ("b", DAY, -100.0), ("b", dt.date(2021, 1, 1), 110.0)], "owner string, date date, amount double")
    got = {r["owner"]: r["xirr"] for r in ledgers.xirr(flows.unionByName(end), "owner").collect()}
    worth = lambda rate: sum(-1_000_000 / 3000 * (1 + rate) ** (-k / 365.25) for k in range(3000)) + 1_500_000 * (1 + rate) ** (-4000 / 365.25)
    assert abs(worth(got["a"] / 100)) < 2_000 and worth(got["a"] / 100 - 1e-3) > 0 > worth(got["a"] / 100 + 1e-3)
    assert got["b"] == pytest.approx(100 * (1.1 ** (365.25 / 366) - 1))


# Rolling estimates and budgets


def market(spark, n=140, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal([0.001, 0.0005, 0.0], [0.02, 0.01, 0.005], (n, 3))
    x[:, 1] += 0.3 * x[:, 0]
    return x, spark.createDataFrame([(day(k), a, float(v)) for k, row in enumerate(x) for a, v in zip("abc", row)], "date date, asset string, r double")


def test_rolling_covariances(spark):
    x, panel = market(spark)
    spans = [(0, 0, 60), (1, 20, 80), (2, 20, 140), (3, 75, 76 + 31)]
    rows = moments.rolling_covariances(panel, evaluation.numbered(panel), spans).collect()
    for fold, first, end in spans:
        want, told = solve.shrunk(x[first:end])
        for r in (r for r in rows if r["fold"] == fold):
            assert r["v"] == pytest.approx(want["abc".index(r["i"]), "abc".index(r["j"])], rel=1e-8, abs=1e-14)
            assert r["shrinkage"] == pytest.approx(told["shrinkage"], rel=1e-6) and r["n"] == end - first
    assert len(rows) == 9 * len(spans)


def test_folds_are_fitted_as_one_by_one(spark):
    x, panel = market(spark)
    spans = [(0, 10, 90), (1, 50, 140)]
    got = evaluation.estimates(panel, spans).where("asset IS NOT NULL").collect()
    for fold, first, end in spans:
        want, _ = solve.allocations(solve.shrunk(x[first:end])[0])
        have = {}
        for r in (r for r in got if r["fold"] == fold):
            have.setdefault(r["method"], {})[r["asset"]] = r["w"]
        assert set(have) == set(want)
        for m, w in want.items():
            assert [have[m][a] for a in "abc"] == pytest.approx(w.tolist(), abs=1e-5)


def test_rolling_budget_step_by_step(spark):
    """The ledger of chosen targets, by steps: a purchase at each fold's first date that its costs reduce, then drift."""
    x, panel = market(spark)
    plan = budget.Budget(limit=0.9, horizon=40, paths=250, most_paths=250, blocks=(10,), tolerance=0.9, seed=3)
    got = evaluation.budget_walk_forward(panel, plan, least=60, step=40, window=60, rate=0.002)
    path = got["ledger"].where("path = 'actual'").orderBy("date").collect()
    held, cash = np.zeros(3), 100_000.0
    assert [f["fold"] for f in got["folds"]] == [0, 1] and len(path) == 80
    for f, fold in enumerate(got["folds"]):
        start = 60 + 40 * f
        target = solve.allocations(solve.shrunk(x[max(0, start - 60) : start])[0])[0][fold["selected"]]
        total, cost = held.sum() + cash, 0.0
        for _ in range(200):  # what is traded depends on what its costs leave
            cost = 0.002 * np.abs(target * (total - cost) - held).sum()
        held, cash = target * (total - cost), (total - cost) * (1 - target.sum())
        for k in range(40):
            held = held * (1 + x[start + k])
            assert path[40 * f + k]["value"] == pytest.approx(held.sum() + cash, rel=1e-6)


def test_budget_of_accounts(spark):
    rng = np.random.default_rng(9)
    series = {"calm": rng.normal(0.004, 0.01, 60), "bold": rng.normal(0.02, 0.09, 60), "idle": np.zeros(60)}
    rows = [(name, k, float(r)) for name, rs in series.items() for k, r in enumerate(rs)]
    got = {r["account"]: r for r in budget.screened(spark.createDataFrame(rows, "account string, ix int, r double"), 0.15, 24, paths=60, block=6.0, seed=5).collect()}
    cells = ledgers.bootstrap_rows(spark, 60, 60, 24, 6.0, 5).orderBy("path", "step").collect()
    drawn = np.asarray([c["row_ix"] for c in cells]).reshape(60, 24)
    best = None
    for name, rs in series.items():
        nav = np.cumprod(1 + rs[drawn], axis=1)
        falls = (1 - nav / np.maximum(1, np.maximum.accumulate(nav, axis=1))).max(axis=1)
        p95, median = np.quantile(falls, 0.95), np.median(nav[:, -1])
        assert (got[name]["p95"], got[name]["median"], got[name]["feasible"]) == (pytest.approx(p95), pytest.approx(median), p95 <= 0.15)
        if p95 <= 0.15 and (best is None or median > best[1]):
            best = name, median
    assert [n for n, r in got.items() if r["chosen"]] == [best[0]] == ["calm"]
    with pytest.raises(InputError):
        budget.screened(spark.createDataFrame(rows[:-1], "account string, ix int, r double"), 0.15, 24)


def test_equity_becomes_returns_after_fees_once(spark):
    equity = spark.createDataFrame([("a", 1, 110.0), ("a", 2, 99.0)], "account string, ix int, net double")
    assert [r["r"] for r in budget.net_returns(equity, 100.0, "account").orderBy("ix").collect()] == pytest.approx([0.1, -0.1])


def test_percentiles_put_no_target_beside_the_values_below_it(spark):
    rng = random.Random(11)
    values = [(g, k, rng.choice([0.5, 1.5, round(rng.uniform(-9, 9), 1)])) for g in ("a", "b") for k in range(300)] + [("c", 1, None), ("c", 2, 1.0)]
    targets = [(g, t) for g in ("a", "b", "c") for t in (-10.0, 0.5, 0.55, 2.0, 10.0, None)] + [("d", 1.0)]
    rows = spark.createDataFrame(values, "grp string, security long, value double").repartition(8)
    got = exposure.percentile_in(spark.createDataFrame(targets, "grp string, target double"), rows.select("grp", "security"), rows, "grp")
    assert "LessThanOrEqual" not in got._jdf.queryExecution().optimizedPlan().toJSON()
    have = {(r["grp"], r["target"]): r["percentile"] for r in got.collect()}
    assert len(have) == len(targets) - 1
    for g, t in targets[:-1]:
        mine = [v for h, _, v in values if h == g]
        below = [sum(v < t for v in mine), sum(v == t for v in mine)] if t is not None and g != "c" else [0, 0]
        assert have[g, t] == (None if g == "c" else 100 * (below[0] + below[1] / 2) / len(mine))


# Intervals


@pytest.mark.parametrize("n,p", [(20, 0.5), (25, 0.3), (80, 0.95), (200, 0.9)])
def test_ranks_of_an_interval_by_counting(n, p):
    chance = [sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k)) for k in range(1, n + 1)]
    low, high = [k for k, c in zip(range(1, n + 1), chance) if c <= 0.025], [k for k, c in zip(range(1, n + 1), chance) if 1 - c <= 0.025]
    assert solve.interval_ranks(n, p) == ((low[-1], high[0]) if low and high else None)


def test_too_few_values_have_no_interval():
    assert solve.interval_ranks(19, 0.5) is None and solve.interval_ranks(50, 0.99) is None


def test_sharpe_interval(spark):
    rng = np.random.default_rng(10)
    rows = [(day(k), float(r)) for k, r in enumerate(rng.normal(0.001, 0.01, 120))]
    got = budget.sharpe_interval(spark.createDataFrame(rows, "date date, r double"), paths=80, block=10.0, seed=4)
    cells = ledgers.bootstrap_rows(spark, 120, 80, 120, 10.0, 4).orderBy("path", "step").collect()
    r = np.asarray([x for _, x in rows])[np.asarray([c["row_ix"] for c in cells]).reshape(80, 120)]
    ratio = r.mean(axis=1) / r.std(axis=1, ddof=1) * np.sqrt(252)
    assert got["status"] == "ok" and got["interval"] == pytest.approx(np.quantile(ratio, [0.025, 0.975]).tolist())
    flat = spark.createDataFrame([(day(k), 0.01) for k in range(30)], "date date, r double")
    assert budget.sharpe_interval(flat, paths=20)["status"] == "insufficient_data"
    with pytest.raises(InputError):
        budget.sharpe_interval(flat.limit(1))
