import random
import re
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import neardup

SCHEMA = "doc_id long, text string, value string, label string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets(docs, n):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    return out


def brute(docs, n):
    s = sets(docs, n)
    low = {i: i for i in s}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i), find(i) == i) for i in s}


def sample(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs, k = [], 0
    for n in (3, 8, 30, 64, 66, 90, 250):
        base = text(n)
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 12))):
                t[rng.randrange(n)] = rng.choice(words)
            docs.append((k := k + 1, " ".join(t)))
    shared = text(60)
    docs += [(200 + j, " ".join(shared + text(12))) for j in range(25)]
    docs += [(300 + j, " ".join(text(40))) for j in range(30)]
    return docs + [(400, None), (401, ""), (402, " \n\t"), (403, "One"), (404, "one"), (405, "one two"), (406, docs[0][1].upper()), (407, "x\x00y z"), (408, "x\x00y z")]


def check(spark, docs, n):
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "v", "l") for i, t in docs], SCHEMA), words=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(docs, n)
    assert len(got) == len(docs)


def test_against_all_pairs(spark):
    check(spark, sample(random.Random(4)), 2)


def test_five_words(spark):
    check(spark, sample(random.Random(5)), 5)


def test_no_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 300), max_size=64), st.sets(st.integers(0, 300), max_size=64)), min_size=1, max_size=5))
def test_estimates(pairs):
    a, b = ([np.sort(np.asarray(sorted(p[k]), dtype="<u4")).tobytes() for p in pairs] for k in (0, 1))
    want = [len([v for v in sorted(x | y)[:64] if v in x and v in y]) / max(1, min(64, len(x | y))) for x, y in pairs]
    assert neardup.union_estimates(a, b).tolist() == want
    assert [neardup.union_estimate(x, y) for x, y in zip(a, b)] == want


def test_very_long_text(monkeypatch):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abAB\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(900))
    for t in (text, "x" * 400, "x" * 400 + " y", "\t\n " * 200):
        want = neardup.shingles([t], 5)[0].tolist()
        with monkeypatch.context() as m:
            m.setattr(neardup, "PART", 64)
            assert neardup.shingles(["a b", t], 5)[1].tolist() == want


def test_large_group(spark):
    """Copies of one text with more and less changes: most are linked with the leader, the others must be told from all members."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    docs = []
    for k in range(260):
        t = list(base)
        for _ in range(rng.choice((0, 3, 6, 8, 9, 10, 12, 20))):
            t[rng.randrange(len(t))] = word()
        docs.append((k, " ".join(t[: rng.choice((150, 150, 146, 135))])))
    check(spark, docs, 2)


def test_one_row_of_a_group(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a, "v", "l"), (5, a, "v", "l"), (5, b, "v", "l"), (5, b, "v", "l"), (7, b + " more", "v", "l"), (8, c, "v", "l"), (8, a, "w", "l"), (None, a, "v", "l"), (9, "", "v", "l"), (10, None, "v", "l")]
    got = neardup.deduplicated(spark.createDataFrame(rows, SCHEMA), 5)
    assert got.columns == ["doc_id", "text", "value", "label"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(0, a), (3, a), (5, b), (8, c), (9, ""), (10, "")])


def test_members_that_few_others_hold_are_joined_before_pairs_are_made(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(200)]

    def changed(n, who):
        at = set(rng.sample(range(200), n))
        return " ".join(f"x{who}y{k % 7}" if k in at else w for k, w in enumerate(words))

    # The last 60 are similar to the plain ones at most; the others, which have one label already, to each other.
    texts = [" ".join(words), changed(1, 0), *(changed(5, k) for k in range(1, 100)), *(changed(10, k) for k in range(100, 160))]
    hashes = [s.view(np.int64).tolist() for s in neardup.shingles(texts, 2)]
    full = spark.createDataFrame(list(enumerate(hashes)), "rep long, hashes array<long>")
    labels = spark.createDataFrame([(k, 0) for k in range(101)], "node long, label long")
    placed = neardup.placed_values(spark.createDataFrame([(1, k, 0.0) for k in range(len(texts))], "value long, rep long, own double"), labels, full)
    split = neardup.split_values(placed, labels)
    scouted, every = neardup.scouted(split), neardup.remaining(split)
    joined = neardup.merged(neardup.confirmed(scouted, full, 80), labels)
    left = neardup.remaining(neardup.split_values(placed, joined))
    assert scouted.count() < every.count() / 4 and left.count() < every.count() / 10
    last = neardup.merged(neardup.confirmed(left, full, 80), joined)
    assert {r["label"] for r in last.collect()} == {0} and last.count() == len(texts)
