"""Linear programmes and least squares over their solutions, for the driver's problems of a few hundred variables."""

from __future__ import annotations

import numpy as np

SMALL = 1e-9


def _pivot(table: np.ndarray, row: int, col: int) -> None:
    table[row] /= table[row, col]
    for other in np.flatnonzero(np.abs(table[:, col]) > 0):
        if other != row:
            table[other] -= table[other, col] * table[row]


def _solve(table: np.ndarray, basis: np.ndarray, usable: int) -> None:
    """Bland's rule, which can't cycle: the first column that improves enters, of the rows that bind first the one with the least variable leaves."""
    while True:
        better = np.flatnonzero(table[-1, :usable] < -SMALL)
        if not len(better):
            return
        col = int(better[0])
        up = np.flatnonzero(table[:-1, col] > SMALL)
        if not len(up):
            raise ValueError("the programme has no bound")
        ratio = table[up, -1] / table[up, col]
        tied = up[ratio <= ratio.min() + 1e-12]
        row = int(tied[np.argmin(basis[tied])])
        _pivot(table, row, col)
        basis[row] = col


def minimise(cost: np.ndarray, most: np.ndarray | None = None, limit: np.ndarray | None = None, equal: np.ndarray | None = None, value: np.ndarray | None = None) -> np.ndarray | None:
    """x >= 0 with the least ``cost`` @ x, ``most`` @ x <= ``limit`` and ``equal`` @ x = ``value``, by the two-phase simplex; None if there is none."""
    n = len(cost)
    most = np.zeros((0, n)) if most is None else np.asarray(most, dtype=float)
    equal = np.zeros((0, n)) if equal is None else np.asarray(equal, dtype=float)
    m, k = len(most), len(equal)
    body = np.zeros((m + k, n + m))
    body[:m, :n], body[m:, :n] = most, equal
    body[:m, n:] = np.eye(m)
    right = np.concatenate([np.zeros(0) if limit is None else limit, np.zeros(0) if value is None else value]).astype(float)
    flip = right < 0
    body[flip], right[flip] = -body[flip], -right[flip]
    helped = np.flatnonzero(flip | (np.arange(m + k) >= m))  # rows whose slack can't start them
    table = np.zeros((m + k + 1, n + m + len(helped) + 1))
    table[:-1, : n + m], table[:-1, -1] = body, right
    table[helped, n + m + np.arange(len(helped))] = 1.0
    basis = n + np.arange(m + k)
    basis[helped] = n + m + np.arange(len(helped))
    table[-1] = -table[helped].sum(axis=0)
    table[-1, n + m : -1] = 0.0
    _solve(table, basis, n + m)
    if table[-1, -1] < -1e-7 * max(1.0, np.abs(right).max(initial=0.0)):
        return None
    for row in np.flatnonzero(basis >= n + m):  # a helper that stays at zero leaves if it can
        free = np.flatnonzero(np.abs(table[row, : n + m]) > SMALL)
        if len(free):
            _pivot(table, row, int(free[0]))
            basis[row] = free[0]
    table[:, n + m : -1] = 0.0
    table[-1] = 0.0
    table[-1, :n] = cost
    for row, col in enumerate(basis):
        if col < n and abs(table[-1, col]) > 0:
            table[-1] -= table[-1, col] * table[row]
    _solve(table, basis, n + m)
    x = np.zeros(n + m + len(helped))
    x[basis] = table[:-1, -1]
    return x[:n]


def nearest(matrix: np.ndarray, offset: np.ndarray, most: np.ndarray, limit: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 with ``most`` @ x <= ``limit`` and the least square of ``matrix`` @ x + ``offset``: the linear programme finds the corner that the slope points to, and the
    best mixture of the corners so far is solved exactly."""
    corners = [start]
    x = start
    for _ in range(rounds):
        slope = 2 * matrix.T @ (matrix @ x + offset)
        corner = minimise(slope, most, limit)
        if corner is None or slope @ (corner - x) > -1e-14 * max(1.0, abs(float(slope @ x))):
            break
        corners.append(corner)
        points = np.asarray(corners)
        at, weights = points @ matrix.T, np.full(len(points), 1 / len(points))
        gram, line = at @ at.T, at @ offset
        for _ in range(2000):  # projected steps on the mixture, which has few parts
            step = weights - (gram @ weights + line) / max(1e-300, np.linalg.norm(gram, 2))
            ordered = np.sort(step)[::-1]
            level = (np.cumsum(ordered) - 1) / np.arange(1, len(step) + 1)
            new = np.maximum(step - level[np.flatnonzero(ordered > level)[-1]], 0)
            if np.abs(new - weights).max() < 1e-15:
                break
            weights = new
        x = weights @ points
        corners = [c for c, w in zip(corners, weights) if w > 1e-12]
    return x
