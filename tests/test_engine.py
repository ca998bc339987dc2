import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import cli, demo, engine, sinks, sources
from tallyspark.operators import evaluation, network, solve
from tallyspark.operators.budget import Budget
from tallyspark.operators.linear import minimise, nearest
from tallyspark.operators.returns import InputError


def test_linear_programmes():
    x = minimise(np.asarray([-3.0, -5.0]), np.asarray([[1.0, 0.0], [0.0, 2.0], [3.0, 2.0]]), np.asarray([4.0, 12.0, 18.0]))
    assert x == pytest.approx([2, 6])
    assert minimise(np.zeros(2), np.asarray([[1.0, 1.0]]), np.asarray([1.0]), np.asarray([[1.0, 1.0]]), np.asarray([2.0])) is None
    assert minimise(np.ones(2), equal=np.asarray([[1.0, 2.0]]), value=np.asarray([4.0])) == pytest.approx([0, 2])
    near = nearest(np.eye(2), np.asarray([-2.0, -2.0]), np.asarray([[1.0, 1.0]]), np.asarray([1.0]), np.asarray([1.0, 0.0]))
    assert near == pytest.approx([0.5, 0.5], abs=1e-6)


def test_feasible_points():
    limits = solve.Limits(np.asarray([0.0, 0.0, 0.2]), np.asarray([0.5, 0.5, 1.0]), [([0, 1], 0.6, 0.7)])
    w = solve.feasible_point(limits)
    assert limits.broken(w) < 1e-9
    none = solve.Limits(np.zeros(3), np.full(3, 0.3))
    assert solve.feasible_point(none) is None and solve.allocations(np.eye(3), none) == ({}, {"all": "infeasible"})


def test_run_and_report(spark, tmp_path):
    panel = demo.panel(spark, days=700)
    config = demo.config() | {"walk_forward": {"min_train": 400, "test_steps": 150}, "stress": {"fall": ("2014-06-01", "2014-12-01")}, "cashflows": {"2015-01-05": 1000.0}}
    config["current_holdings"] = {"bond": 20_000, "gold": 5_000, "stock_a": 60_000, "stock_b": 15_000}
    config["cashflows"] = {panel.agg(F.max("date")).first()[0].isoformat(): 1000.0}
    report = engine.run(panel, config, factors=demo.factors(spark, days=700))
    methods = {r["method"] for r in report.rows["M1"]}
    assert {"equal_weight", "min_variance", "risk_parity", "max_diversification"} <= methods and report.reference in methods
    assert report.tables["held_out"].count() == len({r["method"] for r in report.rows["M1"] if "w" in r})
    assert report.conclusions and {r["status"] for r in report.rows["M4"]} <= {"ok", "infeasible"} and report.facts["walk_forward"] in ("ok", "degraded")
    assert {r["term"] for r in report.rows["factor_regression"]} == {"alpha", "market", "rate"}
    assert report.tables["irr"].first()["status"] == "ok" and report.tables["stress"].count() == 1
    target = f"{tmp_path}/report"
    sinks.save_report(report, target)
    told = sources.frozen(spark, target)
    assert "report.html" in told["files"] and "ledger" in told["tables"]
    body = json.loads((tmp_path / "report" / "report.json").read_text())
    assert body["reference"] == report.reference
    with pytest.raises(InputError):
        sinks.save_report(report, target)
    (tmp_path / "report" / "report.html").write_text("changed")
    with pytest.raises(InputError):
        sources.frozen(spark, target)


def test_run_refuses(spark):
    panel = demo.panel(spark, days=200)
    for bad in ({"more": 1}, {"data": {"return_type": "price", "source": "x", "currency": "CNY"}}, {"data": {}}):
        with pytest.raises(InputError):
            engine.run(panel, demo.config() | bad)


def test_rolling_budget(spark):
    panel = demo.panel(spark, days=420)
    plan = Budget(limit=0.9, horizon=60, paths=250, most_paths=250, blocks=(10,), every=20, tolerance=0.5, seed=3)
    got = evaluation.budget_walk_forward(panel, plan, least=300, step=60, rate=0.001)
    assert [f["fold"] for f in got["folds"]] == [0, 1] and got["complete"] and got["eligible"] == 2 and got["no_solution_rate"] == 0
    path = got["ledger"].where("path = 'actual'").orderBy("date").collect()
    assert len(path) == 120 and path[-1]["nav"] == pytest.approx(np.prod([1 + r["r"] for r in path]))
    assert path[60]["value"] == pytest.approx(path[59]["value"] * (1 + path[60]["r"]))
    none = evaluation.budget_walk_forward(panel, Budget(**{**vars(plan), "limit": 0.0001}), least=300, step=60, rate=0.001)
    assert none["no_solution_rate"] == 1 and none["breach_rate"] is None and none["ledger"].where("path = 'actual' AND cash < value - 1e-6").count() == 0


def test_regression_by_sums_is_the_dense_one(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=(300, 2)), rng.normal(size=300)
    y = 0.5 + x @ np.asarray([1.0, -2.0]) + e + np.append(0, e[:-1])
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(300)]
    rows = solve.hac_rows(spark.createDataFrame([(d, float(v)) for d, v in zip(days, y)], "date date, y double"),
        spark.createDataFrame([(d, n, float(v)) for d, r in zip(days, x) for n, v in zip("ab", r)], "date date, asset string, r double"))
    want = solve.hac_regression(y, x)
    assert [r["beta"] for r in rows] == pytest.approx([want["alpha"], *want["beta"]]) and [r["error"]
        for r in rows] == pytest.approx(list(want["error"])) and rows[0]["r2"] == pytest.approx(want["r2"])
    assert [r["inflation"] for r in rows][1:] == pytest.approx(list(want["inflation"]))


def samples(spark, n=60):
    rng = np.random.default_rng(1)
    out = []
    for k in range(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
        for s in range(3):
            close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, 8)))
            history = [(float(c * 0.999), float(c * 1.01), float(c * 0.99), float(c), 100.0) for c in close]
            out.append((f"{k}-{s}", f"S{s}", at, history, float(0.5 * (close[-1] / close[-2] - 1)), at + dt.timedelta(days=1)))
    return spark.createDataFrame(out, "id string, security string, signal_at timestamp, history array<struct<open:double,high:double,low:double,close:double,volume:double>>, y double, available_at timestamp")


def folds(spark):
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    return spark.createDataFrame([("f", d(0), d(29), d(30), d(39), d(40), d(59))],
        "fold string, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date")


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = network.Net.drawn(5, 1)
    x, y = rng.normal(size=(6, 8, 5)), rng.normal(size=6)
    _, slopes = net.gradients(x, y)
    for name, part in net.parts.items():
        for at in [tuple(rng.integers(0, s) for s in part.shape) for _ in range(4)]:
            kept, step = part[at], 1e-6
            part[at] = kept + step
            up = net.gradients(x, y)[0]
            part[at] = kept - step
            down = net.gradients(x, y)[0]
            part[at] = kept
            assert slopes[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-7)


def test_network_learns_and_is_frozen(spark):
    rows = network.checked_samples(samples(spark), 8)
    staged = network.staged_samples(network.with_channels(rows), folds(spark), embargo_days=0)
    assert staged.where("stage = 'train'").count() == 29 * 3  # the last day's labels are known when validation begins
    fit = network.fit_folds(staged, epochs=60, rate=0.02).first()
    assert fit["test_mse"] < 0.7 * fit["baseline_mse"] and 1 <= fit["epoch"] <= 60
    test = network.with_channels(rows).where("id = '50-1'").drop("y", "available_at")
    score = network.predict(test, fit["model"]).first()["score"]
    assert score == pytest.approx({s["id"]: s["score"] for s in fit["scores"]}["50-1"])
    with pytest.raises(InputError):
        network.Net.loaded(fit["model"].replace('"epoch"', '"other"'))
    with pytest.raises(InputError):
        network.checked_samples(rows, 8, labelled=False)
    with pytest.raises(InputError):
        network.checked_samples(rows.selectExpr("id", "security", "signal_at", "history", "y", "signal_at AS available_at"), 8)
    table = network.compared(staged, network.staged_samples(network.with_channels(rows, True), folds(spark)), rows.select("id", F.lit(0).alias("signal")), epochs=2).first()
    assert table["rules"] == pytest.approx(fit["baseline_mse"], rel=1e-6) and table["geometry"] > 0


def test_bridge_takes_no_late_scores(spark):
    rows = samples(spark, 4)
    scores = rows.select("id", "security", "signal_at", F.lit(0.1).alias("score"))
    labels = rows.select("id", "security", "signal_at", "y", "available_at")
    late = F.lit(dt.datetime(2025, 1, 1))
    assert network.bridge(scores, labels, F.lit(dt.datetime(2023, 1, 1)), late).count() == 12
    for computed, some in ((late, labels), (F.lit(dt.datetime(2023, 1, 1)), labels.limit(5))):
        with pytest.raises(InputError):
            network.bridge(scores, some, computed, late)


def test_commands(spark, tmp_path):
    assert cli.main(["nav", "demo", "--output", f"{tmp_path}/nav"], spark) == 0
    assert cli.main(["verify", "--input", f"{tmp_path}/nav"], spark) == 0
    assert cli.main(["nav", "demo", "--output", f"{tmp_path}/nav"], spark) == 2 and (tmp_path / "nav.failure.json").exists()
    assert cli.main(["nav", "demo", "--output", f"{tmp_path}/nav", "--auto-name"], spark) == 0 and (tmp_path / "nav-2").exists()
    (tmp_path / "exit.json").write_text(json.dumps({"flows": [{"case": "a", "date": "2020-01-01", "kind": "buy", "amount": -100}, {"case": "a", "date": "2021-01-01", "kind": "sale", "amount": 110}]}))
    assert cli.main(["exit-cash", "--input", f"{tmp_path}/exit.json", "--output", f"{tmp_path}/exit"], spark) == 0
    assert json.loads((tmp_path / "exit" / "result.json").read_text())["result"][0]["multiple"] == pytest.approx(1.1)
    (tmp_path / "bad.json").write_text('{"flows": [], "flows": []}')
    assert cli.main(["exit-cash", "--input", f"{tmp_path}/bad.json", "--output", f"{tmp_path}/bad"], spark) == 2
    assert cli.main(["doctor"], spark) == 0


def test_cases_are_told(spark):
    got = {c["case"]: c["status"] for c in demo.statistical_cases(spark)}
    assert got == {"sparse_tail": "insufficient_data", "repeated_selection": "biased", "test_isolation": "broken"}


def test_wide_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("date,a,b\n2024-01-01,0.1,0.2\n2024-01-02,-0.1,0.0\n")
    (tmp_path / "o.csv").write_text("date,a,b\n2024-01-02,5,-3\n")
    panel = sources.read_wide(spark, f"{tmp_path}/r.csv")
    assert sources.read_orders(spark, f"{tmp_path}/o.csv", ["a", "b"]).count() == 2
    with pytest.raises(InputError):
        sources.read_orders(spark, f"{tmp_path}/o.csv", ["a"])
    with pytest.raises(InputError):
        sources.read_factors(spark, f"{tmp_path}/o.csv", panel)
    (tmp_path / "link.json").symlink_to(tmp_path / "r.csv")
    with pytest.raises(InputError):
        sources.local_input(f"{tmp_path}/link.json")
    assert sinks.clean({"a": float("nan"), "b": [np.float64(1.5), dt.date(2024, 1, 1)]}) == {"a": None, "b": [1.5, "2024-01-01"]}


def reviewed(spark, tmp_path, name, action, spec):
    (tmp_path / f"{name}.json").write_text(json.dumps(spec))
    assert cli.main(["factor", action, "--input", f"{tmp_path}/{name}.json", "--output", f"{tmp_path}/{name}"], spark) == 0
    return json.loads((tmp_path / name / "result.json").read_text())


def test_factor_actions(spark, tmp_path):
    rows = [{"signal_date": f"2024-01-{d:02}", "security": f"s{k}", "factor": k, "fwd": k / 10, "start": f"2024-01-{d:02}", "end": f"2024-01-{d + 3:02}"} for d in (1, 3, 9) for k in range(10)]
    got = reviewed(spark, tmp_path, "series", "series", {"rows": rows})
    assert [w["overlaps"] for w in sorted(got["windows"], key=lambda w: w["start"])] == [False, True, False] and all(d["rank_ic"] == pytest.approx(1) for d in got["dates"])
    account = {"periods": [{"ix": k} for k in (1, 2, 3)], "returns": [{"ix": k, "security": "a", "r": 0.1} for k in (1, 2, 3)], "trades": [{"ix": 1, "security": "a", "notional": 50}],
        "cash": 100, "bps": [0, 100]}
    got = reviewed(spark, tmp_path, "cost", "cost", account)
    assert {(r["bps"], r["ix"]): r["net"] for r in got["periods"]}[100.0, 3] == pytest.approx(50 + 50 * 1.1**3 - 0.5)
    got = reviewed(spark, tmp_path, "budget", "budget", account | {"limit": 0.5, "horizon": 5, "paths": 20})
    assert [r["chosen"] for r in sorted(got["rates"], key=lambda r: r["bps"])] == [True, False]
    need = {"positions": [{"position_id": "cash", "kind": "cash", "amount": 100, "frozen_amount": 0}], "cashflows": [{"id": "i", "kind": "income", "date": "2024-02-01", "amount": 10}],
        "frozen_releases": [], "planned_liquidations": [], "liquidity": []}
    need |= {"scenarios": [{"scenario": "normal", "income_multiplier": 1, "additional_haircut": 0, "settlement_delay_days": 0, "freeze_release_enabled": True}],
        "valuation_date": "2024-01-01", "horizon_end": "2024-03-01"}
    got = reviewed(spark, tmp_path, "fit", "cashfit", need | {"plans": [{"id": "p", "can_trade": True, "date": "2024-01-10", "amount": 130}]})
    assert got["scenarios"][0]["conflict"] == pytest.approx(30) and got["scenarios"][0]["added"] == pytest.approx(30)
    rng = np.random.default_rng(1)
    many = [{"security": f"s{k}", "value": float(rng.normal()), "size": float(rng.normal()), "industry": "ab"[k % 2], "market_cap": float(rng.random() + 1)} for k in range(20)]
    got = reviewed(spark, tmp_path, "multi", "multi", {"rows": many, "factors": ["value", "size"], "weights": {"value": 0.5, "size": 0.5}})
    assert len(got["scores"]) == 20 and {r["status"] for r in got["scores"]} <= {"ok", "degraded"}
    got = reviewed(spark, tmp_path, "exposed", "exposure",
        {"holdings": [{"security": "a", "kind": "stock", "weight": 0.7}, {"security": "b", "kind": "stock", "weight": 0.3}], "values": [{"security": "a", "value": 2}]})
    assert got["exposure"][0]["contribution"] == pytest.approx(1.4) and got["exposure"][0]["unknown"] == pytest.approx(0.3)


def test_standard_input(spark, tmp_path, monkeypatch):
    import io
    import types

    spec = {"flows": [{"case": "a", "date": "2020-01-01", "kind": "buy", "amount": -100}, {"case": "a", "date": "2021-01-01", "kind": "sale", "amount": 110}]}
    monkeypatch.setattr(cli.sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(json.dumps(spec).encode())))
    assert cli.main(["exit-cash", "--input", "-", "--output", f"{tmp_path}/exit"], spark) == 0


def test_large_results_raise(spark):
    assert len(cli._rows(spark.range(cli.MOST))) == cli.MOST
    with pytest.raises(InputError):
        cli._rows(spark.range(cli.MOST + 1))


def test_exposure_page_can_be_handled(spark, tmp_path):
    rows = spark.createDataFrame([("stock", "<a>", 1.0)], "level string, key string, amount double")
    sinks.save_exposure(rows, rows, rows, f"{tmp_path}/page")
    text = (tmp_path / "page" / "report.html").read_text()
    assert all(x in text for x in ("filter", "save as CSV", "onclick", "&lt;a&gt;")) and "<a>" not in text.split("<script>")[0]
