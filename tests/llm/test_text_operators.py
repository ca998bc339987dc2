import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import decontam, hosts, mil, rules, secrets, toxic

SCHEMA = "doc_id long, text string, host string, quality string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [(1, None), (2, ""), (3, " \n \t"), (4, "x"), (5, "word " * 3000), (6, "same text here"), (6, "same text here"), (None, "no id")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "h", "q") for i, t in docs], SCHEMA)


# Benchmark decontamination


def hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        w = split(item)
        n = min(window, len(w))
        spots = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in spots:
                hit.update(range(k, k + n))
                found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [15, 100_000])
def test_decontamination(spark, block):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["ab", "cd", "Éf", "g7", "hi,"]) for _ in range(n))
    items = [(k, text(rng.randint(1, 14))) for k in range(2, 30)] + [(30, None), (31, ""), (32, "cd"), (2, text(12)), (None, "ab ab ab ab")]
    items = [i for i in items if i[1] is None or len(i[1]) > 16 or i[0] is None]
    docs = [(k, text(rng.randint(0, 60))) for k in range(100, 130)] + ODD
    got = decontam.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=10, block_words=block).collect()
    want = [(i, *hits(t, [x for x in items if x[0] is not None], 10)) for i, t in docs if i is not None]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(want)


def test_an_item_of_one_word_again_and_again():
    """As many steps for each word of a text, however long the item: the last state on the way to the root is kept, not sought."""
    for n in (40, 400):
        automaton = decontam.Automaton([("i", [b"w"] * n), ("j", [b"w"] * 12 + [b"x"])], 10)
        words = [b"w"] * 1000
        spans, items = automaton.match(words)
        assert spans == [(0, 1000)] and len(items) == 2
        assert set(automaton.top[s] for s in range(len(automaton.top)) if automaton.size[s] >= 10) <= {s for s in range(len(automaton.top)) if automaton.size[automaton.link[s]] < 10}


def test_cut():
    assert decontam.cut("Keep this, a b c and that.", [(2, 5)], 2, 0.9) == "Keep this,  and that."
    assert decontam.cut("a b c", [(0, 3)], 1, 0.5) is None
    assert decontam.cut("a b c d e", [(0, 1)], 2, 0.5) == "a b c d e"


def test_no_items(spark):
    got = decontam.matches(frame(spark, ODD), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == 7 and not any(r["contaminated"] for r in got)


# Quality rules


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(3)
    docs = [(k, "".join(rng.choice(["a ", "b\n", "É# ", "<x> ", "a b a b a b ", "\t"]) for _ in range(rng.randint(0, 60)))) for k in range(10, 60)] + ODD
    got = rules.judge(frame(spark, docs), []).collect()
    want = []
    for i, t in docs:
        if i is not None:
            s = statistics(t)
            failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
            want.append((i, *s, failed, not failed))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert rules.accepted(frame(spark, docs), []).columns == ["doc_id", "text", "host", "quality"]
    assert rules.accepted(frame(spark, [d for d in docs if d[0]]), []).count() == sum(w[-1] for w in want)


def test_decision_list(spark):
    docs = [(k, f"{'WORD# ' * 30}" if k % 3 == 0 else " ".join(f"word{j * k}" for j in range(30))) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(0, 300, 2)] + [(None, 1, 0), (4, None, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    learnt = rules.fit(frame(spark, docs), labels)
    assert learnt and all(len(r) for r in learnt)
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(frame(spark, docs), learnt).collect()}
    assert kept == {k: k % 3 != 0 for k in range(300)}
    assert rules.fit(frame(spark, docs), labels.limit(0)) == []


# Host reputation


def test_hosts(spark):
    urls = ["http://A.example.net/en/1", "http://x.net/", "http://x.net", "https://B.example.com/de/2?x", "http://q.org/fr/#a", "http://bad.example.com/a", "no url", None, "ftp://u@H:80/p;q?r", "a://b://c", "http://good.example.org/x"]
    pages = [(k, u, "") for k, u in enumerate(urls)] + [(100 + k, "http://bad.example.com/p", "") for k in range(40)] + [(200 + k, "http://good.example.org/p", "") for k in range(40)]
    bad = [(100 + k, 1) for k in range(40)] + [(200 + k, 0) for k in range(40)] + [(5, None), (None, 1), (7777, 1)]
    got = {r["page_id"]: r for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, bad string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert len(got) == len(pages)
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(11)] == [("a.example.net", "/en/1", "example.net/en/"), ("x.net", "/", "net/"), ("x.net", "", None), ("b.example.com", "/de/2", "example.com/de/"), ("q.org", "/fr/", "org/fr/"), ("bad.example.com", "/a", None), ("", "", None), ("", "", None), ("u@h:80", "/p;q", None), ("b:", "//c", None), ("good.example.org", "/x", None)]
    assert [got[k]["verdict"] for k in (0, 1, 3, 4, 5, 10)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert got[5]["bound"] > 0.8 and got[10]["bad_rate"] < 0.2
    none = hosts.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int"))
    assert none.count() == 0


# Toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=12))
def test_maximal_segments(scores):
    at = [k for k, s in enumerate(scores) if s]
    got = [(a, b) for _, a, b in toxic.maximal_segments(at, [float(scores[k]) for k in at], 0.0)]
    # All maximal segments by definition: the best stretch, then the same left and right of it.
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            for b in range(a, hi):
                s = sum(scores[a : b + 1])
                if s > 0 and (top is None or (s, a - b) > (top[0], top[1] - top[2])):
                    top = (s, a, b)
        return [] if top is None else best(lo, top[1]) + [top[1:]] + best(top[2] + 1, hi)

    assert sum(sum(scores[a : b + 1]) for a, b in got) == sum(sum(scores[a : b + 1]) for a, b in best(0, len(scores)))


def labelled(n):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(n):
        t = [rng.choice("red green blue some word here and there now then".split()) for _ in range(rng.randint(5, 200))]
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["nastyword", "awfulthing", "vilestuff"]))
        docs.append((k, " ".join(t)))
        if k % 2 == 0:
            labels.append((k, int(k % 7 != 0), int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled(900)
    got = toxic.toxicity(frame(spark, [*docs, (5000, None), (5001, "")]), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["doc_id"] < 900 and r["doc_id"] % 5 == 0)
    text = dict(docs)
    for r in got:
        for p in r["passages"] or []:
            assert text[r["doc_id"]].encode()[p["begin"] : p["end"]].split()[0] in (b"nastyword", b"awfulthing", b"vilestuff")
    assert toxic.toxicity(frame(spark, docs[:3]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("predicted = 1").count() == 0


# Quality classifier


def test_gradients_fall():
    rng = np.random.default_rng(0)
    bags = [rng.normal(0, 1, (rng.integers(1, 6), mil.FEATURES)) for _ in range(300)]
    y = np.asarray([float(b[:, 0].max() > 1) for b in bags])
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    score, attention = mil.predict(mil.train(np.concatenate(bags), bounds, y, epochs=300), np.concatenate(bags), bounds)
    assert ((score > 0.5) == y).mean() > 0.9
    assert np.allclose(np.add.reduceat(attention, bounds[:-1]), 1)


def test_quality(spark):
    rng = random.Random(2)
    docs = [(k, " ".join((rng.choice("abc") * 4 + "%%%" * (k % 4 == 0)) for _ in range(rng.randint(20, 300)))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(600)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = mil.quality(frame(spark, [*docs, *ODD[:2]]), labels).collect()
    assert len(got) == 602 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["held_out"] and r["doc_id"] > 2]
    assert sum(right) / len(right) > 0.97


# Secrets


def test_training_findings_are_made_once(spark, monkeypatch):
    plans, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), collect(df))[1])
    word = F.concat(F.lit("marker="), F.sha2(F.col("id").cast("string"), 256))
    secrets.fit(spark.range(40).select("id", word.alias("word"), F.lit("").alias("before"), F.lit("").alias("after"), (F.col("id") % 2).alias("secret")))
    assert len(plans) == 1 and plans[0].count("marker=") == 1  # a filter that is pushed down would repeat it


def test_secrets(spark):
    forest = secrets.fit(secrets.made_findings(spark))
    docs = [(1, 'so token = "3c4226790fc3f8022bcc4434e93601b2005f1325" it was'), (2, "the card 4464761703690345 here"), (3, "see https://www.example.com/images/201234/photo"), (4, "use secret: Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA now"), *[(10 + i, t) for i, t in ODD if i]]
    found = {r["doc_id"]: r["secret"] for r in secrets.findings(frame(spark, docs), forest).collect()}
    assert found == {1: True, 2: False, 3: False, 4: True}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame(spark, docs), forest).collect()}
    assert clean[1] == 'so token = "[SECRET]" it was' and clean[4] == "use secret: [SECRET] now"
    assert all(clean[i] == t for i, t in docs if i not in (1, 4))
    assert secrets.findings(frame(spark, []), forest).count() == 0


A, B = "3c4226790fc3f8022bcc4434e93601b2005f1325", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA"


@pytest.mark.parametrize(
    ("text", "clean", "found"),
    [
        (f"see https://www.example.com/cb?token={B} now", "see https://www.example.com/cb?[SECRET] now", [False, True]),
        (f'so {{"token":"{A}","secret":"{B}"}} it', 'so {"token":"[SECRET]","secret":"[SECRET]"} it', [True, True]),
        (f'so {{"sha1":"{A[::-1]}","commit":"{A}","secret":"{B}"}} it', f'so {{"sha1":"{A[::-1]}","commit":"{A}","secret":"[SECRET]"}} it', [False, False, True]),
        (f"secret: {B}:{B}x7", "secret: [SECRET]:[SECRET]", [True, True]),
    ],
)
def test_each_run_of_a_word_is_a_candidate(spark, text, clean, found):
    forest = secrets.fit(secrets.made_findings(spark))
    assert sorted(r["secret"] for r in secrets.findings(frame(spark, [(1, text)]), forest).collect()) == sorted(found)
    assert secrets.redacted(frame(spark, [(1, text)]), forest).first()["text"] == clean


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ('the password: "S3cr3tPw1" was', 'the password: "[SECRET]" was'),
        ("so pwd = Tr0ub4dor&3xQ it", "so pwd = [SECRET] it"),
        ("so password=Ab3!xY9@kLm2 it", "so password=[SECRET] it"),
        ("the  secret: kQwZrtXvBnmPlKjHgFdSaYui\n now", "the  secret: [SECRET]\n now"),
        ('{"user":"bob","password":"S3cr3tPw1"}', '{"user":"bob","password":"[SECRET]"}'),
        ("ghp_16C7e42F292c6912E7710c838347Ae178B4a is live", "[SECRET] is live"),
        ("at postgres://admin:S3cretPassw0rd@db1.example.com:5432/app now", "at postgres://admin:[SECRET]@db1.example.com:5432/app now"),
        ("so secret = correcthorsebatterystaple it", "so secret = [SECRET] it"),
        ("DB_PASSWORD=Tr0ub4dor&3", "DB_PASSWORD=[SECRET]"),
        ("see https://www.example.com:8080/path?first=1&second=2 there", None),
        ("the password protection and key features are private property", None),
        ("as follows: something, title: mountains and status=finished", None),
    ],
)
def test_values_that_neighbours_name_are_candidates(spark, text, clean):
    forest = secrets.fit(secrets.made_findings(spark))
    assert secrets.redacted(frame(spark, [(1, text)]), forest).first()["text"] == (clean or text)


def test_secrets_planted_in_the_table(spark):
    """All that is planted (forty hexadecimal digits in quotes behind ``token =``) is found, and nothing else is taken for a secret."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = Counter((r["doc_id"], m[1][:4] + "…", 40) for r in docs.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"] or ""))
    found = secrets.findings(docs, secrets.fit(secrets.made_findings(spark))).collect()
    assert Counter((r["doc_id"], r["masked"], r["length"]) for r in found if r["secret"]) == planted and sum(planted.values()) > 10 and len(found) > 2 * sum(planted.values())


# Bounds, borders and brute force


def test_hosts_of_both_kinds_are_decided_by_outcomes(spark):
    """Pages show the documents that their paths name; one host's are bad, its neighbours' are not, and a host without outcomes follows its domain."""
    from tallyspark.llm import queries

    pages, labels = [], []
    for k in range(300):
        host = ("www.spam.example.com", "blog.good.example.org", "m.fine.example.org")[k % 3]
        pages.append((k, f"https://{host}/en/{1000 + k}.html?x=1"))
        labels.append((1000 + k, int(k % 3 != 0), 0) if k % 2 else (1000 + k, 1, int(k % 3 == 0)))
    pages += [(900, "https://new.spam.test/en/5000"), (901, "https://www.spam.example.com/about"), (902, None)]
    pages, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*labels, (None, 0, 0), (1001, None, None)], "doc_id long, quality int, toxic int")
    outcomes = queries.page_outcomes(pages, labels)
    assert outcomes.count() == 300
    got = {r["page_id"]: (r["verdict"], r["host"]) for r in hosts.judge(pages, outcomes, rules=()).collect()}
    assert {v for v, h in got.values() if h == "www.spam.example.com"} == {"block"}
    assert {v for v, h in got.values() if h.endswith("example.org")} == {"allow"} and got[902][0] == "allow"


def test_many_automata_are_loaded_once_for_many_texts(monkeypatch):
    import pickle

    items = [(f"i{k}", decontam.words_of(f"one{k} two{k} three{k}")) for k in range(5)]
    stored = {f"p{k}": pickle.dumps(decontam.Automaton([it], 3)) for k, it in enumerate(items)}
    loads = []
    monkeypatch.setattr(decontam, "fetch", lambda uri: loads.append(uri) or stored[uri])
    decontam._loaded.cache_clear()
    texts = [f"x one{k % 5} two{k % 5} three{k % 5} y" for k in range(100)]
    got = decontam._scans(sorted(stored), texts)
    decontam._loaded.cache_clear()
    assert len(loads) == 5 and [(n, s, i) for n, s, i in got] == [(5, [(1, 4)], [f"i{k % 5}"]) for k in range(100)]


def test_long_texts_part_by_part(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["Plain", "nastyword", "x#", "é", "1,2", "\n", "AGAIN"]) for _ in range(1500)).encode()
    whole_x, whole_b = mil.encode([text, b"short one"])
    model = toxic.Model(np.sort(toxic.features(toxic.Words.of([b"nastyword"]))[0]), np.full(6, 4.0))
    whole_s = model.segments([text, b"a nastyword b"])
    automaton = decontam.Automaton([("i", decontam.words_of("again plain"))], 2)
    whole_m = automaton.match(decontam.words_of(text))
    for module in (mil, toxic, decontam):
        monkeypatch.setattr(module, "PART", 200)
    monkeypatch.setattr(decontam, "parts", lambda raw, f=decontam.parts: f(raw, 200))
    monkeypatch.setattr(toxic, "parts", lambda raw, f=toxic.parts: f(raw, 200))
    x, b = mil.encode([text, b"short one"])
    assert (b == whole_b).all() and np.allclose(x, whole_x)
    assert [(n, [(round(s, 9), *r) for s, *r in f]) for n, f in model.segments([text, b"a nastyword b"])] == [(n, [(round(s, 9), *r) for s, *r in f]) for n, f in whole_s]
    monkeypatch.setattr(decontam, "_loaded", lambda uri: automaton)
    assert decontam._scans(["p"], [text.decode()])[0][1] == whole_m[0]
    assert decontam.cut(text.decode(), whole_m[0], 1, 1.0) == "".join(_without(text.decode(), whole_m[0]))


@pytest.mark.parametrize("part", [1, 7, 40, 200])
def test_signs_of_long_texts_stay(monkeypatch, part):
    rng = random.Random(part)
    bits = ["##### ", "!!!!", " \n \n", "| | |", "Word ", "another,", " one two "]
    texts = ["# ! " * 300 + "words at last " * 90 + "!!! " * 200, "!" * 900, " " * 500, "".join(rng.choice(bits) for _ in range(900)), "only words " * 64 + "#" * 999]
    whole = [mil.encode([t.encode()]) for t in texts]
    monkeypatch.setattr(mil, "PART", part)
    for t, (x, b) in zip(texts, whole):
        got, bounds = mil.encode([t.encode()])
        assert (bounds == b).all() and np.allclose(got, x, atol=1e-6)


def test_features_of_long_texts_count_once(monkeypatch):
    text = " ".join(f"word{k % 40} again beginning{k % 7}" for k in range(500)).encode()
    keys, _ = toxic.features(toxic.Words.of([text]))
    monkeypatch.setattr(toxic, "parts", lambda raw, f=toxic.parts: f(raw, 90))
    assert (toxic.held_features(text) == np.unique(keys)).all()


def test_odds_by_definition(spark):
    rows = [(1, 30, 2), (2, 2, 0), (3, 3, 900), (4, 12, 12), (5, 200, 1)]
    toxic_sum, clean_sum = 300.0, 2000.0
    got = {r["key"]: r["odds"] for r in toxic.weighed(spark.createDataFrame(rows, "key long, toxic long, clean long"), toxic_sum, clean_sum).collect()}
    want = {}
    for key, t, c in rows:
        prior = toxic.PRIOR * (t + c) / (toxic_sum + clean_sum)
        y1, y0 = t + prior, c + prior
        odds = np.log(y1 / (toxic_sum + toxic.PRIOR - y1)) - np.log(y0 / (clean_sum + toxic.PRIOR - y0))
        if t >= toxic.SEEN and odds / np.sqrt(1 / (y1 + 0.5) + 1 / (y0 + 0.5)) >= toxic.SURE:
            want[key] = min(odds, toxic.MOST)
    assert got == pytest.approx(want) and 0 < len(want) < 5


def _without(text, spans):
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))]
    at = 0
    for b, e in spans:
        yield text[at : places[b][0]]
        at = places[e - 1][1]
    yield text[at:]


def test_attention_by_definition():
    """Scores of one bag at a time, from the formulas."""
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, mil.FEATURES)) for n in (1, 3, 5)]
    model = mil.train(np.concatenate(bags).astype(np.float32), np.asarray([0, 1, 4, 9]), np.asarray([0.0, 1.0, 1.0]), epochs=3)
    score, attention = mil.predict(model, np.concatenate(bags).astype(np.float32), np.asarray([0, 1, 4, 9]))
    at = 0
    for k, bag in enumerate(bags):
        h = np.tanh(np.clip((bag - model["mean"]) / model["std"], -8, 8) @ model["w"] + model["b"])
        e = np.asarray([float((np.tanh(r @ model["v"]) / (1 + np.exp(-(r @ model["u"])))) @ model["a"]) for r in h])
        a = np.exp(e) / np.exp(e).sum()
        assert attention[at : at + len(bag)] == pytest.approx(a, rel=1e-4)
        assert score[k] == pytest.approx(1 / (1 + np.exp(-((a[:, None] * h).sum(axis=0) @ model["c"] + model["d"][0]))), rel=1e-4)
        at += len(bag)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=12))
def test_segments_have_the_right_borders(scores):
    """Segments as Ruzzo and Tompa define them: no part of one that is a prefix or suffix has a sum of zero or less, and none can be made longer without losing that."""
    at = [k for k, s in enumerate(scores) if s]
    got = [(a, b) for _, a, b in toxic.maximal_segments(at, [float(scores[k]) for k in at], 0.0)]
    good = lambda a, b: all(sum(scores[a : k + 1]) > 0 for k in range(a, b + 1)) and all(sum(scores[k : b + 1]) > 0 for k in range(a, b + 1))
    every = [(a, b) for a in range(len(scores)) for b in range(a, len(scores)) if good(a, b)]
    maximal = [(a, b) for a, b in every if not any((c, d) != (a, b) and c <= a and b <= d for c, d in every)]
    assert sorted(got) == sorted(maximal)


def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mil.quality(none, labels).count() == rules.judge(none, rules.fit(none, labels)).count() == toxic.toxicity(none, labels).count() == 0


def test_repeated_rows_teach_once(spark):
    docs = [(k, f"{'WORD# ' * 30}" if k % 3 == 0 else " ".join(f"word{j * k}" for j in range(30))) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    once, often = frame(spark, docs), frame(spark, docs + [docs[0]] * 500)
    assert rules.fit(once, labels) == rules.fit(often, labels)
    known = labels.select("doc_id", "quality").withColumnRenamed("quality", "label")
    a, b = mil.fit(once.select("doc_id", "text"), known), mil.fit(often.select("doc_id", "text"), known)
    assert all(np.array_equal(a[n], b[n]) for n in a)


def test_passages_are_bounded(spark):
    docs = [(k, f"word{k} " * 640) for k in range(20)]  # ten passages each
    known = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, label int")
    taken = []
    real = mil.train
    try:
        mil.train = lambda x, bounds, y: taken.append((len(x), len(y))) or real(x, bounds, y, epochs=1)
        for most in (1, 35, 1000):
            mil.fit(frame(spark, docs).select("doc_id", "text"), known, most=most)
    finally:
        mil.train = real
    assert taken == [(10, 1), (30, 3), (200, 20)]
