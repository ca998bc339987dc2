"""Look-through by doubling, and its table function, against a walk edge by edge."""

import random

import pytest

from tallyspark import functions
from tallyspark.operators import exposure
from tallyspark.operators.returns import InputError

EDGE = "node string, child string, kind string, weight double"


def walked(edges, roots, depth):
    """[(root, leaf, kind, w, reason, path)] by recursion."""
    of = {}
    for node, child, kind, w in edges:
        of.setdefault(node, []).append((child, kind, w))
    out = []

    def walk(root, node, w, path):
        total = sum(x[2] for x in of[node])
        if 1 - total > 1e-12:
            out.append((root, "unknown", "unknown", w * (1 - total), "undisclosed", path))
        for child, kind, part in of[node]:
            if part <= 0:
                continue
            reason = "unknown_kind" if kind == "unknown" else None
            if kind == "fund":
                reason = "cycle" if child in path else "depth_limit" if len(path) >= depth else "missing_child" if child not in of else None
                if reason is None:
                    walk(root, child, w * part, (*path, child))
                    continue
            out.append((root, child if reason is None else "unknown", kind if reason is None else "unknown", w * part, reason, (*path, child)))

    for root in roots:
        if root in of:
            walk(root, root, 1.0, (root,))
    return sorted(out, key=lambda r: (r[0], r[5], r[1], str(r[4]), r[3]))


def paths(spark, edges, roots, depth):
    rows = exposure.paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r,) for r in roots], "root string"), depth).collect()
    return sorted(((r["root"], r["leaf"], r["kind"], r["w"], r["reason"], tuple(r["path"])) for r in rows), key=lambda r: (r[0], r[5], r[1], str(r[4]), r[3]))


def same(got, want):
    assert [(*r[:3], *r[4:]) for r in got] == [(*r[:3], *r[4:]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def graph(rng, funds=7, leaves=4):
    """Funds that hold funds, themselves too, leaves, unknowns and funds that aren't there; a child may be held twice."""
    edges = []
    for k in range(funds):
        parts = rng.randint(1, 3)
        for _ in range(parts):
            kind = rng.choice(["fund", "fund", "stock", "unknown"])
            child = f"F{rng.randint(0, funds)}" if kind == "fund" else f"S{rng.randint(0, leaves)}" if kind == "stock" else "?"
            edges.append((f"F{k}", child, kind, rng.choice([0.1, 0.25, 0.3, 0.0])))
    return edges


@pytest.mark.parametrize("seed,depth", [(1, 1), (2, 2), (3, 3), (4, 5), (5, 8), (6, 10), (7, 6)])
def test_graphs_with_cycles(spark, seed, depth):
    edges = graph(random.Random(seed)) + [(f"F{k}", "F8", "fund", 0.1) for k in (0, 2)]  # F8 has no holdings
    roots = ["F0", "F3", "F3", "F9"]
    same(paths(spark, edges, roots, depth), walked(edges, sorted(set(roots)), depth))


def ladder(levels):
    """Two funds on each level, each of which holds both of the next one."""
    return [(f"L{k}{a}", f"L{k + 1}{b}", "fund", 0.5) for k in range(levels - 1) for a in "xy" for b in ("x", "y") if k < 6
        or (a, b) in (("x", "x"), ("y", "y"))] + [(f"L{levels - 1}{a}", f"leaf{a}", "stock", 1.0) for a in "xy"]


@pytest.mark.parametrize("levels", [20, 21])
def test_twenty_levels(spark, levels):
    edges = ladder(levels)
    got = paths(spark, edges, ["L0x"], 20)
    same(got, walked(edges, ["L0x"], 20))
    assert {r[4] for r in got} == ({None, "undisclosed"} if levels == 20 else {"depth_limit", "undisclosed"}) and sum(r[3] for r in got) == pytest.approx(1)


def test_weights_and_kinds_are_checked(spark):
    for bad in ([("a", "b", "stock", 0.7), ("a", "c", "stock", 0.4)], [("a", "b", "stock", -0.1)], [("a", "b", "stock", 0.1), ("c", "b", "bond", 0.1)]):
        with pytest.raises(InputError):
            paths(spark, bad, ["a"], 5)
    with pytest.raises(InputError):
        paths(spark, [("a", "b", "stock", 0.1)], ["a"], 21)


def test_no_edges(spark):
    assert paths(spark, [], ["a"], 5) == []


def test_table_function(spark):
    functions.register(spark)
    edges = [(root, *e) for root in ("F0", "F2", "F5") for e in graph(random.Random(9))]
    rows = spark.sql("SELECT t.* FROM lookthrough(TABLE(SELECT * FROM {edges}) PARTITION BY (root), 6) AS t", edges=spark.createDataFrame(edges, f"root string, {EDGE}")).collect()
    want = walked(graph(random.Random(9)), ["F0", "F2", "F5"], 6)
    key = lambda r: (r[0], r[1], r[2], str(r[4]), round(r[3], 12))
    got = sorted((tuple(r) for r in rows), key=key)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in sorted(want, key=key)] and sum(r[3] for r in got) == pytest.approx(3)
