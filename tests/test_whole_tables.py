"""Queries take in the whole of their tables; brute force over the smallest ones."""

import datetime as dt

import numpy as np
import pytest

from tallyspark.operators import factors, ledgers
from tallyspark.plans import catalog
from tallyspark.plans import views as v

TABLES = "/root/testdata/sf0.001"


def flags(spans):
    """Of rows (start, end, ...) in order: whether each starts before an earlier one has ended."""
    out, last = {}, None
    for row in sorted(spans):
        out[row] = last is not None and row[0] < last
        last = row[1] if last is None else max(last, row[1])
    return out


def test_series_overlap_judges_every_order(spark):
    lines = v.table(spark, TABLES, "lineitem").select("l_orderkey", "l_shipdate").collect()
    dates = {}
    for r in lines:
        dates.setdefault(r[0], []).append(r[1].date() if isinstance(r[1], dt.datetime) else r[1])
    want = flags((min(x), max(x), k) for k, x in dates.items())
    got = {tuple(r[n] for n in ("start", "end", "id")): r["overlaps"] for r in catalog.QUERIES["series_overlap"](spark, TABLES).collect()}
    spans = [x[:2] for x in want]
    assert got == want and len(got) == len(dates) and len(set(spans)) < len(spans)


def test_overlaps_carries_the_latest_end(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    spans = [(day(0), day(9)), (day(2), day(3)), (day(8), day(8)), (day(9), day(9)), (day(9), day(12)), (day(9), day(14)), (day(20), day(21)), (day(20), day(22)), (day(20), day(22)),
        (day(30), day(30)), (day(30), day(30))]
    rows = [(a, b, k) for k, (a, b) in enumerate(spans)]
    got = factors.overlaps(spark.createDataFrame(rows, "start date, end date, id int"), "id").collect()
    assert {(r["start"], r["end"], r["id"]): r["overlaps"] for r in got} == flags(rows) and len(got) == len(rows)


def test_every_customer_with_a_balance_is_a_lot(spark):
    from tallyspark.plans import accounts

    customers = {f"P{r['c_custkey']}" for r in v.table(spark, TABLES, "customer").where("c_acctbal > 0").select("c_custkey").collect()}
    known, unknown, _ = accounts.exposed(spark, TABLES)
    lots = {r["position_id"] for df in (known, unknown) for r in df.select("position_id").distinct().collect()}
    assert customers <= lots and len(customers) > 50


def drawn(spark, horizon=None):
    """Returns on the 200 paths drawn from all returns of A."""
    r = np.asarray([x["r"] for x in v.ret(spark, TABLES).where("asset = 'A'").orderBy("date").collect()])
    cells = ledgers.bootstrap_rows(spark, len(r), 200, horizon or len(r), 10.0, 11).orderBy("path", "step").collect()
    return r[[c["row_ix"] for c in cells]].reshape(200, -1), len(r)


def test_bootstrap_draws_from_all_returns(spark):
    paths, n = drawn(spark, 60)
    nav = np.cumprod(1 + paths, axis=1)
    falls = (1 - nav / np.maximum(1, np.maximum.accumulate(nav, axis=1))).max(axis=1)
    row = catalog.QUERIES["boot_quantiles"](spark, TABLES).first()
    want = {"p95": np.quantile(falls, 0.95), "p99": np.quantile(falls, 0.99), "exceeds": (falls > 0.1).mean(), "median": np.median(nav[:, -1] - 1)}
    assert n != 500 and row.asDict() == pytest.approx(want, abs=2e-7)


def test_sharpe_interval_is_of_paths_as_long_as_the_returns(spark):
    paths, n = drawn(spark)
    ratios = paths.mean(axis=1) / paths.std(axis=1, ddof=1)
    row = catalog.QUERIES["boot_sharpe"](spark, TABLES).first()
    assert paths.shape == (200, n) and row.asDict() == pytest.approx({"low": np.quantile(ratios, 0.025), "high": np.quantile(ratios, 0.975)}, abs=2e-7)


def orders(spark):
    day = lambda x: x.date() if isinstance(x, dt.datetime) else x
    return [(r["o_orderkey"], day(r["o_orderdate"]), r["o_orderpriority"], r["o_orderstatus"], float(r["o_totalprice"])) for r in v.table(spark, TABLES, "orders").collect()]


def test_cutoff_parts_all_orders(spark):
    cut, known = dt.date(1998, 7, 1), {}
    for key, date, *_ in orders(spark):
        known[key] = date + dt.timedelta(days=key % 40) if key % 11 else None
    got = [{r["id"]: r["available"] for r in catalog.QUERIES[q](spark, TABLES).collect()} for q in ("asof_included", "asof_excluded")]
    assert got[0] == {k: a for k, a in known.items() if a and a <= cut} and got[1] == {k: a for k, a in known.items() if not a or a > cut}


def test_cash_knows_all_flows(spark):
    every = orders(spark)
    first, last = min(x[1] for x in every), max(x[1] for x in every)
    net = {}
    for _, date, owner, status, price in every:
        net[owner, date] = net.get((owner, date), 0.0) + (price if status == "F" else -price)
    want, gaps = {}, {}
    for owner in {x[2] for x in every}:
        balance = 1_000_000.0
        for k in range((last - first).days + 1):
            date = first + dt.timedelta(days=k)
            balance += net.get((owner, date), 0.0)
            want[owner, date] = balance
            if balance < 0:
                at, amount, peak = gaps.get(owner, (date, -balance, 0.0))
                gaps[owner] = at, amount, max(peak, -balance)
    got = {(r["owner"], r["date"]): r["balance"] for r in catalog.QUERIES["cash_daily_ledger"](spark, TABLES).collect()}
    assert got == pytest.approx(want, abs=0.02)
    for r in catalog.QUERIES["cash_first_gap"](spark, TABLES).collect():
        at, amount, peak = gaps.get(r["owner"], (None, None, 0.0))
        assert r["first_gap"] == at and r["first_amount"] == pytest.approx(amount, abs=0.02) and r["peak_gap"] == pytest.approx(peak,
            abs=0.02) and r["ending"] == pytest.approx(want[r["owner"], last], abs=0.02)


def test_scenarios_know_all_flows(spark):
    every = orders(spark)
    last, want = max(x[1] for x in every), {}
    for name, times, since, haircut, delay in catalog.SCENARIOS:
        for _, date, owner, status, price in every:
            at = date + dt.timedelta(days=delay if status == "O" else 0)
            amount = price * (times if date >= dt.date.fromisoformat(since) else 1) if status == "F" else price * (1 - haircut) if status == "O" else -price
            if at <= last:
                n, total = want.get((name, owner), (0, 0.0))
                want[name, owner] = n + 1, total + amount
    got = {(r["scenario"], r["owner"]): (r["n"], r["amount"]) for r in catalog.QUERIES["cash_scenarios"](spark, TABLES).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert {k: x[1] for k, x in got.items()} == pytest.approx({k: x[1] for k, x in want.items()}, abs=0.02)
