"""Functions for SQL text: ``register(spark)`` makes them known to a session.

- ``xirr(date, amount)``: an aggregate, percent a year at which dated amounts are worth nothing; null unless money first goes out and then comes back with one change of sign.
- ``expected_shortfall(r, alpha)``: an aggregate, the mean of the worst (1 - alpha) n losses with the boundary loss in part.
- ``lookthrough(TABLE(edges) PARTITION BY (root), depth)``: a table function over fund edges (root, node, child, kind, weight), which gives the leaves of each root.

An aggregate takes a group's values into one task, as Spark's own exact percentiles do; for groups beyond that, :mod:`tallyspark.operators.select` and
:func:`tallyspark.operators.ledgers.xirr` sum up by day or by place first. ``lookthrough`` takes the edges that one root reaches; :func:`tallyspark.operators.exposure.paths` needs no such limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .operators.exposure import DEPTHS, TINY_WEIGHT


def rate_of_return(days: np.ndarray, amounts: np.ndarray) -> float | None:
    """Percent a year of amounts on days, sought on log(1 + r) between -20 and 20."""
    order = np.argsort(days, kind="stable")
    days, at = np.unique(days[order], return_index=True)
    amounts = np.add.reduceat(amounts[order], at) if len(at) else amounts
    days, amounts = days[amounts != 0], amounts[amounts != 0]
    if len(days) < 2 or amounts[0] >= 0 or (np.diff(np.sign(amounts)) != 0).sum() != 1:
        return None
    t = (days - days[0]) / 365.25
    worth = lambda y: float(amounts @ np.exp(-y * t))
    low, high = -20.0, 20.0
    if worth(low) <= 0 or worth(high) >= 0:
        return None
    # Money goes out before it comes back, so the logarithm of what comes in over what goes out falls in the rate, and nearly on a line: a few steps of Newton's, kept between the ends.
    k, y = int(np.argmax(amounts > 0)), 0.0
    for _ in range(100):
        x = -y * t
        each = amounts * np.exp(x - x.max())
        out, back = -float(each[:k].sum()), float(each[k:].sum())
        h = -math.inf if back <= 0 else math.inf if out <= 0 else math.log(back / out)
        low, high = (y, high) if h > 0 else (low, y)
        step = h / (float(each[k:] @ t[k:]) / back + float(each[:k] @ t[:k]) / out) if math.isfinite(h) else math.nan
        last, y = y, y + step if low <= y + step <= high else (low + high) / 2
        if abs(y - last) <= 1e-14 * max(1.0, abs(y)):
            break
    return 100 * math.expm1(y)


def _xirr(date: pa.Array, amount: pa.Array) -> float:
    known = pc.and_(pc.is_valid(date), pc.is_valid(amount))
    date, amount = date.filter(known), amount.filter(known)
    if pa.types.is_date32(date.type):
        days = date.cast(pa.int32()).to_numpy().astype(np.int64)
    else:
        local = pc.local_timestamp(date) if pa.types.is_timestamp(date.type) and date.type.tz else date
        days = pd.to_datetime(local.to_pandas()).to_numpy().astype("datetime64[D]").astype(np.int64)
    amounts = amount.cast(pa.float64(), safe=False).to_numpy()
    some = ~np.isnan(amounts)  # what is no number is not known
    return rate_of_return(days[some], amounts[some])


def _expected_shortfall(r: pd.Series, alpha: pd.Series) -> float:
    loss = np.sort(-r.dropna().to_numpy(dtype=float))[::-1]
    if not len(loss):
        return None
    part = np.clip((1 - float(alpha.iloc[0])) * len(loss) - np.arange(len(loss)), 0.0, 1.0)
    return float(loss @ part / part.sum()) if part.sum() > 0 else None


class Lookthrough:
    """Leaves of one root, walked level by level over its edges. A path stops as in :func:`tallyspark.operators.exposure.paths`; the root is the partition's."""

    def __init__(self) -> None:
        self.edges: dict[str, list[tuple[str, str, float]]] = {}
        self.root: str | None = None
        self.depth = DEPTHS[1]

    def eval(self, edge: Row, depth: int) -> None:
        if not DEPTHS[0] <= depth <= DEPTHS[1]:
            raise ValueError(f"depth goes from {DEPTHS[0]} to {DEPTHS[1]}")
        self.root, self.depth = edge["root"], depth
        self.edges.setdefault(edge["node"], []).append((edge["child"], edge["kind"], edge["weight"]))

    def terminate(self) -> Iterator[tuple]:
        front = [(self.root, 1.0, (self.root,))] if self.root in self.edges else []
        for level in range(1, self.depth + 1):
            ahead = []
            for node, w, path in front:
                total = sum(x[2] for x in self.edges[node])
                if 1 - total > TINY_WEIGHT:
                    yield self.root, "unknown", "unknown", w * (1 - total), "undisclosed"
                for child, kind, part in self.edges[node]:
                    if part <= 0:
                        continue
                    reason = "unknown_kind" if kind == "unknown" else None
                    if kind == "fund":
                        reason = "cycle" if child in path else "depth_limit" if level == self.depth else "missing_child" if child not in self.edges else None
                        if reason is None:
                            ahead.append((child, w * part, (*path, child)))
                            continue
                    yield self.root, child if reason is None else "unknown", kind if reason is None else "unknown", w * part, reason
            front = ahead


def register(spark: SparkSession) -> None:
    """Make ``xirr``, ``expected_shortfall`` and ``lookthrough`` known to SQL text in ``spark``."""
    spark.udf.register("xirr", F.arrow_udf(_xirr, "double"))
    spark.udf.register("expected_shortfall", F.pandas_udf(_expected_shortfall, "double"))
    spark.udtf.register("lookthrough", F.udtf(Lookthrough, returnType="root string, leaf string, kind string, w double, reason string"))
