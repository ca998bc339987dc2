import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pytest

from tallyspark.llm import resample

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, score string, rank string"


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[k : k + size]) for size in range(1, n + 1) for k in range(len(words) - size + 1)]


def brute(docs, target, n, size, least, part):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, t = (Counter(bucket(f) for x in texts for f in features(x, n)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + size) / ((s[b] + 1) * (all_t + size))))
    rows = []
    for i, x in docs:
        if i is None:
            continue
        words, f = features(x, n)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0], r[1]))
    drawn = drawn[: part[0] * len(drawn) // part[1]]
    ranks = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(r[:4], []).append(k + 1)
    out = []
    for r in rows:
        left = ranks.get(r[:4])
        out.append((*r[:4], left.pop(0) if left else None))
    return sorted(out, key=str)


def documents():
    rng = random.Random(12)
    words = ["alpha", "Beta", "gamma-ray", "delta1", "Éclair", "zeta", "the", "of"]
    docs = [(rng.randint(0, 40), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    docs += [(500, "same words here " * 8)] * 30  # one id and text many times: all keys tie
    return docs + [(200, None), (201, ""), (202, " .,\n"), (None, "alpha " * 30), (203, "long text " * 9000)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(6)


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("small", [False, True])
def test_equal_to_one_sort(spark, monkeypatch, n, small):
    target = ["gamma ray alpha", None, "", "Éclair of zeta"]
    if small:
        monkeypatch.setattr(resample, "RUN", 7)
        monkeypatch.setattr(resample, "RANGE", 3)
        monkeypatch.setattr(resample.write_runs, "__defaults__", (7, 2))
    got = resample.resample(frame(spark, documents()), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=50, least_words=10, part=(40, 100))
    rows = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()]
    assert sorted(rows, key=str) == brute(documents(), target, n, 50, 10, (40, 100))


def test_tournament():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 3), r) for _ in range(rng.randint(0, 12))) for r in range(k)]
        every = sorted(row for run in runs for row in run)
        for limit in (0, 1, 5, len(every), len(every) + 3):
            got = list(resample.tournament([iter(r) for r in runs], limit))
            assert got[:limit] == every[:limit] and sorted(got) == every


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(frame(spark, []), none).collect() == []
    rows = resample.resample(frame(spark, [(1, None), (2, "few words")]), none).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in rows) == [(1, 0, None), (2, 2, None)]


def test_parts_of_long_texts(monkeypatch):
    from tallyspark.llm import wordhash

    text = " ".join(f"w{k % 37}" for k in range(400)).encode()
    whole = sorted(int(b) for _, out in resample.buckets_of(text, 3, resample.Buckets(1000)) for b in out)
    monkeypatch.setattr(wordhash, "PART", 50)
    parts = list(resample.buckets_of(text, 3, resample.Buckets(1000)))
    assert len(parts) > 10 and sorted(int(b) for _, out in parts for b in out) == whole and sum(n for n, _ in parts) == 400
