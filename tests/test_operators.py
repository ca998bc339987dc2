import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import candles, factors, ledgers, returns, risk

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def series(spark, values, asset="a"):
    return spark.createDataFrame([(day(k), asset, float(r)) for k, r in enumerate(values)], "date date, asset string, r double")


def test_expected_shortfall_takes_part_of_the_boundary(spark):
    row = risk.expected_shortfall(series(spark, [-0.4, -0.2, 0.0, 0.1]), "asset", alpha=0.7).first()
    assert row["es"] == pytest.approx((0.4 + 0.2 * 0.2) / 1.2) and row["status"] == "insufficient_data"


def test_drawdown_counts_the_start(spark):
    assert risk.summary(series(spark, [-0.2, 0.25]), "asset").first()["max_drawdown"] == pytest.approx(0.2)


def test_diversification_of_a_diagonal(spark):
    cov = spark.createDataFrame([(i, j, v if i == j else 0.0, 9) for i, v in (("a", 0.01), ("b", 0.04), ("c", 0.09)) for j in "abc"], "i string, j string, v double, n long")
    w = {"a": 6 / 11, "b": 3 / 11, "c": 2 / 11}
    weights = spark.createDataFrame(list(w.items()), "asset string, w double")
    assert [r["share"] for r in risk.risk_contributions(cov, weights).collect()] == pytest.approx([1 / 3] * 3)
    assert risk.concentration(cov, weights).first()["diversification"] == pytest.approx(math.sqrt(3))


def test_panel_must_be_complete(spark):
    assert returns.checked_returns(series(spark, [0.1, 0.2])).count() == 2
    for values in ([0.1, float("nan")], [-1.0, 0.1]):
        with pytest.raises(returns.InputError):
            returns.checked_returns(series(spark, values))
    with pytest.raises(returns.InputError):
        returns.checked_returns(series(spark, [0.1, 0.2]).union(series(spark, [0.1], "b")))


@pytest.mark.parametrize("cash, split, last", [(0.1, None, 1.0), (None, 2.0, 0.55)])
def test_total_return_index(spark, cash, split, last):
    nav = spark.createDataFrame([("x", day(0), 1.0), ("x", day(1), 0.9 if cash else 0.5), ("x", day(2), 0.99 if cash else 0.55)], "code string, date date, nav double")
    events = spark.createDataFrame([("x", day(1), cash, split)], "code string, date date, cash double, split double")
    index = [r["index"] for r in returns.total_return_index(nav, events).orderBy("date").collect()]
    assert index == pytest.approx([1, 1, 1.1])
    with pytest.raises(returns.InputError):
        returns.total_return_index(nav, events.withColumn("date", F.date_add("date", 30)))


def test_xirr(spark):
    flows = [("a", dt.date(2020, 1, 1), -100.0), ("a", dt.date(2021, 1, 1), 110.0), ("b", dt.date(2020, 1, 1), -100.0), ("b", dt.date(2021, 1, 1), 230.0), ("b", dt.date(2022, 1, 1), -132.0)]
    got = {r["k"]: r["xirr"] for r in ledgers.xirr(spark.createDataFrame(flows, "k string, date date, amount double"), "k").collect()}
    assert got["a"] == pytest.approx(100 * (1.1 ** (365.25 / 366) - 1)) and got["b"] is None


def test_fixed_notional_account(spark):
    periods = spark.createDataFrame([(1,), (2,)], "ix int")
    rets = spark.createDataFrame([(1, "s", 0.1), (2, "s", -0.05), (1, "t", 0.0), (2, "t", 0.0)], "ix int, security string, r double")
    trades = spark.createDataFrame([(1, "s", 50.0), (1, "t", 10.0)], "ix int, security string, notional double")
    rows = ledgers.fixed_notional(periods, rets, trades, 100.0, bps=F.lit(20.0)).orderBy("ix").collect()
    assert [r["gross"] for r in rows] == pytest.approx([105.0, 102.25]) and [r["net"] for r in rows] == pytest.approx([104.88, 102.13])


def test_lookthrough_keeps_all_weight(spark):
    edges = [("root", "f1", "fund", 0.5), ("root", "s1", "stock", 0.3), ("f1", "s1", "stock", 0.4), ("f1", "root", "fund", 0.2), ("f1", "gone", "fund", 0.3)]
    rows = ledgers.lookthrough(spark.createDataFrame(edges, "node string, child string, kind string, weight double"), "root").collect()
    assert sum(r["w"] for r in rows) == pytest.approx(1)
    assert {r["reason"]: r["w"] for r in rows if r["kind"] == "unknown" and r["reason"] != "undisclosed"} == pytest.approx({"cycle": 0.1, "missing_child": 0.15})
    assert sum(r["w"] for r in rows if r["leaf"] == "s1") == pytest.approx(0.5)


def test_ties_share_ranks_and_buckets(spark):
    panel = spark.createDataFrame([(DAY, f"s{k}", f, float(k)) for k, f in enumerate([1.0, 1.0, 1.0, 4.0, 5.0, 6.0])], "signal_date date, security string, factor double, fwd double")
    rows = {r["security"]: (r["fr"], r["bucket"]) for r in factors.ranked(panel, 3).collect()}
    assert rows == {"s0": (2.0, 1), "s1": (2.0, 1), "s2": (2.0, 1), "s3": (4.0, 2), "s4": (5.0, 3), "s5": (6.0, 3)}


def test_stability_breaks_runs(spark):
    rows = [(1, "a", 0.1), (2, "a", -0.1), (3, "a", 0.0), (4, "b", 0.2), (5, "a", -0.2), (6, "a", None), (7, "a", -0.3), (8, "a", 0.4)]
    got = {r["grp"]: r for r in factors.stability(spark.createDataFrame(rows, "at int, grp string, ic double")).collect()}
    assert got["a"]["flips"] == 2 and got["a"]["longest_non_positive"] == 2 and got["b"]["flips"] is None
    assert got["a"]["greatest_fall"] == pytest.approx(0.6)


def bar(k, o, h, lo, c):
    return ("x", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(o), float(h), float(lo), float(c), 1.0)


SCHEMA = "security string, at timestamp, open double, high double, low double, close double, volume double"
FALL = [bar(0, 14, 14.2, 12.8, 13), bar(1, 13, 13.2, 11.8, 12), bar(2, 12, 12.2, 10.8, 11)]
RISE = [bar(0, 7, 8.2, 6.8, 8), bar(1, 8, 9.2, 7.8, 9), bar(2, 9, 10.2, 8.8, 10)]


@pytest.mark.parametrize(
    "pattern, bars",
    [
        ("doji", [*FALL, bar(3, 11, 12, 10, 11.05)]),
        ("hammer", [*FALL, bar(3, 11, 11.25, 9.8, 11.2)]),
        ("hanging_man", [*RISE, bar(3, 10, 10.25, 8.8, 10.2)]),
        ("inverted_hammer", [*FALL, bar(3, 11, 12.4, 10.95, 11.2)]),
        ("shooting_star", [*RISE, bar(3, 10, 11.4, 9.95, 10.2)]),
        ("bullish_engulfing", [*FALL, bar(3, 11, 11.1, 10.4, 10.5), bar(4, 10.4, 11.6, 10.3, 11.5)]),
        ("bearish_engulfing", [*RISE, bar(3, 10, 10.6, 9.9, 10.5), bar(4, 10.6, 10.7, 9.4, 9.5)]),
        ("morning_star", [*FALL, bar(3, 11, 11.1, 8.9, 9), bar(4, 8.6, 8.9, 8.3, 8.7), bar(5, 9.2, 10.6, 9.1, 10.5)]),
        ("evening_star", [*RISE, bar(3, 10, 12.1, 9.9, 12), bar(4, 12.3, 12.6, 12.0, 12.4), bar(5, 11.9, 12.0, 10.2, 10.4)]),
        ("three_white_soldiers", [*FALL, bar(3, 10, 11.1, 9.9, 11), bar(4, 11, 12.1, 10.9, 12), bar(5, 12, 13.1, 11.9, 13)]),
        ("three_black_crows", [*RISE, bar(3, 11, 11.1, 9.9, 10), bar(4, 10, 10.1, 8.9, 9), bar(5, 9, 9.1, 7.9, 8)]),
    ],
)
def test_candle_rules(spark, pattern, bars):
    found = candles.rules(spark.createDataFrame(bars, SCHEMA))
    last = max(b[1] for b in bars)
    status = {r["pattern"]: r["status"] for r in found.where(F.col("at") == F.lit(last)).collect()}
    assert status[pattern] == "matched"
    alone = candles.rules(spark.createDataFrame(bars[-1:], SCHEMA)).collect()
    assert all(r["status"] in ("not-matched", "context-unknown") or r["pattern"] == "doji" for r in alone)


def test_cornish_fisher():
    assert risk.cornish_fisher(0.0, 0.0, 0.95) == pytest.approx(1.6448536269514722)
    assert risk.cornish_fisher(3.0, 1.0, 0.95) is None


def test_ledger_hand_values(spark):
    from tallyspark.operators.backtest import backtest

    rows = [("p", day(0), "a", 0.1), ("p", day(0), "b", 0.0), ("p", day(1), "a", 0.0), ("p", day(1), "b", 0.2)]
    panel = spark.createDataFrame(rows, "path string, date date, asset string, r double")
    got = backtest(panel, {"a": 0.5, "b": 0.5}, every=1).orderBy("date").collect()
    assert [r["value"] for r in got] == pytest.approx([105.0, 115.5])
    flat = backtest(panel.withColumn("r", F.lit(0.0)), {"a": 1.0, "b": 0.0}, rate=0.01).orderBy("date").collect()
    assert flat[0]["value"] == pytest.approx(100 / 1.01) and flat[1]["cost"] == 0
    moved = backtest(panel.withColumn("r", F.lit(0.0)), {"a": 0.5, "b": 0.5}, flows={str(day(1)): -40.0}).orderBy("date").collect()
    assert moved[1]["value"] == pytest.approx(60.0) and moved[1]["nav"] == pytest.approx(1.0)


def test_strict_json():
    from tallyspark.sources import digest, strict_json

    assert strict_json(b'{"a": [1, 2.5, null]}') == {"a": [1, 2.5, None]}
    for bad in (b'{"a": 1, "a": 2}', b"NaN", b"[1e999]", b"{", b"\xff"):
        with pytest.raises(returns.InputError):
            strict_json(bad)
    assert digest({"b": 1, "a": 2}) == digest({"a": 2, "b": 1})


def test_wide_tables(spark, tmp_path):
    from tallyspark.sources import read_wide

    path = tmp_path / "prices.csv"
    path.write_text("﻿date,a,b\n2020-01-01,1,2\n2020-01-02,1.1,2\n")
    assert [tuple(r)[1:] for r in read_wide(spark, str(path), "prices").orderBy("asset").collect()] == [("a", pytest.approx(0.1)), ("b", 0.0)]
    path.write_text("date,a,a\n2020-01-01,1,2\n")
    with pytest.raises(returns.InputError):
        read_wide(spark, str(path))


def test_publish_and_verify(spark, tmp_path):
    from tallyspark.sources import manifest, publish, verify

    target = str(tmp_path / "out")
    publish({"t": spark.range(3).toDF("x")}, {"run": 1}, target)
    with pytest.raises(returns.InputError):
        publish({}, {}, target)
    record = spark.createDataFrame(manifest(spark, target).collect())
    assert verify(record, manifest(spark, target)).count() == 0
    (tmp_path / "out" / "receipt.json").write_text("{}")
    (tmp_path / "out" / "more.txt").write_text("x")
    assert {tuple(r) for r in verify(record, manifest(spark, target)).collect()} == {("receipt.json", "changed"), ("more.txt", "extra")}
