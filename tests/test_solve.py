import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.operators import backtest, solve
from tallyspark.operators.returns import InputError


def test_closed_forms():
    found, failed = solve.allocations(np.diag([0.01, 0.04, 0.09]))
    assert not failed
    assert found["risk_parity"] == pytest.approx(np.asarray([6, 3, 2]) / 11, abs=1e-4)
    assert found["min_variance"] == pytest.approx(np.asarray([36, 9, 4]) / 49, abs=1e-5)
    assert found["max_diversification"] == pytest.approx(np.asarray([6, 3, 2]) / 11, abs=1e-4)


@settings(max_examples=6, deadline=None)
@given(st.integers(2, 6), st.integers(0, 10_000))
def test_limits_hold(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n + 2))
    limits = solve.Limits(np.zeros(n), np.full(n, 0.8), [([0, 1], 0.2, 0.7)] if n > 2 else [])
    found, _ = solve.allocations(a @ a.T / n + 0.01 * np.eye(n), limits)
    best = found["min_variance"] @ (a @ a.T / n + 0.01 * np.eye(n)) @ found["min_variance"]
    for w in found.values():
        assert limits.broken(w) < 1e-7 and best <= w @ (a @ a.T / n + 0.01 * np.eye(n)) @ w + 1e-8


def test_infeasible():
    assert solve.allocations(np.eye(2), solve.Limits(np.zeros(2), np.full(2, 0.4))) == ({}, {"all": "infeasible"})


def test_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = x @ [1.2, -0.4] + 0.001 * rng.normal(size=400)
    got = solve.hac_regression(y, x)
    assert got["status"] == "ok" and got["beta"] == pytest.approx([1.2, -0.4], abs=0.01) and got["r2"] > 0.99
    assert solve.hac_regression(y, np.column_stack([x, x[:, 0]]))["status"] == "invalid"
    assert solve.hac_regression(y[:7], x[:7])["status"] == "insufficient_data"


def test_quantile_interval():
    low, high = solve.quantile_interval(np.arange(1000.0), 0.95)
    assert low < 950 < high
    with pytest.raises(InputError):
        solve.quantile_interval(np.arange(20.0), 0.99)


def test_one_view_agrees_with_the_general_form():
    cov = np.asarray([[0.04, 0.01], [0.01, 0.09]])
    w = np.asarray([0.5, 0.5])
    mean, _ = solve.black_litterman(cov, w, np.asarray([[1.0, -1.0]]), np.asarray([0.02]), np.asarray([[0.001]]), 0.05, 2.5)
    p, prior = np.asarray([1.0, -1.0]), 2.5 * cov @ w
    assert mean == pytest.approx(prior + 0.05 * cov @ p * (0.02 - p @ prior) / (0.05 * p @ cov @ p + 0.001))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=2, max_size=4), st.floats(0, 50), st.floats(0, 0.05))
def test_rebalancing_loses_only_costs(held, cash, rate):
    held = np.asarray(held)
    if held.sum() + cash < 1:
        return
    target = np.full(len(held), 0.9 / len(held))
    new, left, cost = backtest.rebalanced(held, cash, target, rate)
    assert new.sum() + left + cost == pytest.approx(held.sum() + cash)
    assert cost == pytest.approx(rate * np.abs(new - held).sum(), abs=1e-7) and left >= -1e-9


def test_migration():
    same = solve.migration_diagnosis(np.asarray([90.0, 10.0]), np.asarray([0.5, 0.5]), 0.0, np.zeros(2), np.zeros(2, bool))
    assert same["trades"] == pytest.approx([-40, 40])
    assert solve.migration_diagnosis(np.asarray([90.0, 10.0]), np.asarray([0.5, 0.5]), 0.0, np.zeros(2), np.asarray([True, False]))["status"] == "infeasible"
