import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import repeats

SCHEMA = "doc_id long, text string, first string"


def brute(docs, length):
    seen, out = set(), {}
    for i, text in sorted((i, (t or "").encode()) for i, t in docs):
        cover = bytearray(len(text))
        for k in range(len(text) - length + 1):
            w = text[k : k + length]
            if w in seen:
                cover[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, c in zip(text, cover) if not c)
        runs = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[i] = (len(text), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=14), min_size=1, max_size=9))
def test_suffixes_are_in_order(words):
    texts = [w.encode() for w in words]
    text, start, common, before = repeats.ordered_suffixes(texts)
    suffixes = [texts[t][s:] for t, s in zip(text, start)]
    assert len(suffixes) == sum(len(t) + 1 for t in texts) and suffixes == sorted(suffixes)
    for k, s in enumerate(suffixes):
        want = 0
        while k and want < min(len(s), len(suffixes[k - 1])) and s[want] == suffixes[k - 1][want]:
            want += 1
        assert common[k] == want
        assert before[k] == (texts[text[k]][start[k] - 1] + 1 if start[k] else 0)


def sample(rng):
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = [(k, rng.choice(base)) for k in range(12)]
    docs += [(20 + k, t[: len(t) // 2] + word() + rng.choice(base)[50:]) for k, (_, t) in enumerate(docs)]
    docs += [(50 + k, word() * 3 + base[0][30:90] + word() * 9) for k in range(25)]
    return docs + [(90, None), (91, ""), (92, "a" * 400), (93, "ab" * 150 + "x"), (94, "short"), (95, "a" * 100)]


def check(spark, docs, length, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(df, length, **more).collect()}
    assert got == brute(docs, length)


def test_against_all_windows(spark):
    check(spark, sample(random.Random(1)), 40)


def test_hot_anchors_and_parts(spark, monkeypatch):
    check(spark, sample(random.Random(2)), 34, hot=2)


def test_a_crowd_takes_one_round(spark, monkeypatch):
    """One passage in many texts, twenty times as many as are put in order together, among neighbours that differ: as many tables are written as for a few."""
    written, real = [], repeats.staged
    monkeypatch.setattr(repeats, "staged", lambda df, name: written.append(name) or real(df, name))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60)))
    passage = "a licence line that very many texts share, word for word, between what is their own"
    counts = []
    for n in (30, 100, 200):
        docs = [(k, word() + passage + word()) for k in range(n)] + [(1000 + k, word() + passage[: 50 + k % 9] + word()) for k in range(9)]
        check(spark, docs, 40, hot=5)
        counts.append(written.count("op6-windows"))
    assert counts == [1, 2, 3]


def test_parts_of_long_texts():
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(5000)).encode()
    whole = repeats.pieces([(1, 0, text)], 40)
    assert sum(whole[3]) == len(text) - 39
    old, repeats.STRIDE = repeats.STRIDE, 700
    try:
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text.decode()]})
        parts = [repeats.pieces(g, 40) for g in repeats.units([batch], 40)]
    finally:
        repeats.STRIDE = old
    starts = sorted(np.concatenate([np.arange(f, f + n) for p in parts for f, n in zip(p[2], p[3])]).tolist())
    assert starts == list(range(len(text) - 39))


def test_no_rows(spark):
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_what_may_be_shared_is_put_in_order(monkeypatch):
    """Of forty pieces under one anchor two share windows: no others are put in order, and the gram of the anchor, which all have, is one symbol."""
    put, real = [], repeats.ordered_suffixes
    monkeypatch.setattr(repeats, "ordered_suffixes", lambda texts: put.extend(texts) or real(texts))
    rng = random.Random(8)
    some = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    left, right, texts, anchor = some(30), some(58), [], []
    for gram in (some(repeats.GRAM), some(repeats.GRAM)):
        texts += [some(40) + gram + some(58) for _ in range(40)] + [some(10) + left + gram + right for _ in range(2)]
        anchor += 42 * [int(repeats.grams(np.frombuffer(gram, dtype=np.uint8)).view(np.int64)[0])]
    rows = np.arange(84)
    text, start = repeats.repeated_windows(texts, np.asarray(anchor), rows, rows * 0, 100)
    # Around both grams stand the same bytes: those windows differ in the gram only, and are no repeats of each other.
    assert sorted(zip(text.tolist(), start.tolist())) == [(k, s) for k in (41, 83) for s in range(10, 31)]
    assert len(put) == 4 and max(map(len, put)) <= 130 - repeats.GRAM + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=5).map(lambda x: x * 8), min_size=1, max_size=12), st.integers(0, 8))
def test_shared_windows_against_brute_force(words, cut):
    """Short periods: the gram stands in a piece more than once, and windows of the same text meet."""
    raw = "".join(words).encode()
    docs = [(1, 0, raw), (2, 0, raw[cut:] + b"c" + raw[: 3 * cut])]
    anchor, doc, first, n, at, joined = repeats.pieces(docs, 36)
    texts = [joined[a : a + k + 35].tobytes() for a, k in zip(at.tolist(), n.tolist())]
    text, start = repeats.repeated_windows(texts, anchor.view(np.int64), doc, first, 36) if texts else ([], [])
    seen, want = set(), set()
    for i, _, t in docs:
        for k in range(len(t) - 35):
            want |= {(i, k)} if t[k : k + 36] in seen else set()
            seen.add(t[k : k + 36])
    assert {(int(doc[t]), int(first[t] + s)) for t, s in zip(text, start)} == want


def test_blocks_change_nothing(monkeypatch):
    raw = np.frombuffer(bytes(random.Random(4).choice(b"abc") for _ in range(3000)), dtype=np.uint8)
    begins, sizes = np.arange(0, 2900, 7), np.full(415, 80)
    whole, told = repeats.anchors(raw, 40), repeats.prints(raw, begins, sizes)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(raw, 40))) and (repeats.prints(raw, begins, sizes) == told).all()


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 9)), max_size=20))
def test_spans_are_merged(spans):
    row, begin, size = (np.asarray([x[k] for x in spans], dtype=np.int64) for k in range(3))
    got = list(zip(*(x.tolist() for x in repeats.merged(row, begin, begin + size))))
    covered = {(r, b) for r, a, n in spans for b in range(a, a + n)}
    assert {(r, b) for r, lo, hi in got for b in range(lo, hi)} == covered
    assert all(p[0] < q[0] or p[2] < q[1] for p, q in zip(got, got[1:]))
