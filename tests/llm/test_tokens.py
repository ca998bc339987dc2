import gc
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import packing, simple8b, tokens
from tallyspark.llm.queries import vocabulary
from tallyspark.llm.tokens import WordIds

SCHEMA = "doc_id long, text string, salt string, base string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def coder():
    return WordIds(vocabulary())


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def ids(coder, *texts):
    got, bounds = coder.encode(pa.array(texts, pa.string()))
    assert len(bounds) == len(texts) + 1 and bounds[-1] == len(got)
    return got.tolist()


def odd_documents():
    long = " ".join(f"word{k} Élan, thing." for k in range(3000))
    return [(7, "Hello world. hello World", "x", "y"), (2, None, None, None), (3, "", "a", "b"), (5, long, "", ""), (9, "Hello world. hello World", "x", "y"), (11, "one two", "", None), (11, "one two", "", None), (12, "日本語 ... it's <|endoftext|> \x01 ß İ ﬁ 42", "", ""), (None, "nobody", "", "")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ .,'\n\té́İΣ 012-"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_library(text):
    c, p = test_ids_equal_the_library.pair
    assert ids(c, text) == p.encode(text, add_special_tokens=False).ids


@pytest.fixture(autouse=True, scope="module")
def _pair(coder, plain):
    test_ids_equal_the_library.pair = (coder, plain)


def test_generations_keep_ids(plain, monkeypatch):
    """Pieces that have grown old, come again or are forgotten get the same ids."""
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "RUN", 3)
    coder = WordIds(vocabulary())
    for k in [0, 1, 2, 0, 9, 1, 0, 0, 3]:
        some = ["", f"a{k}b Word, wörd. {k} plain " + " ".join(chr(97 + k + j) * 2 for j in range(9)), "plain\n", f"<|endoftext|> x{k}"]
        assert ids(coder, *some) == [i for t in some for i in plain.encode(t, add_special_tokens=False).ids]
    assert coder.encode(pa.array([], pa.string()))[1].tolist() == [0] and ids(coder, "", "") == []


def test_remembered_words_are_small():
    """A worker that has met many words holds little for each: dictionaries of Python's took about 200 bytes."""
    coder = WordIds(vocabulary())
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(0, 11_000_000, 137)]
    ids(coder, "warm")
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    for k in range(0, len(words), 8000):
        ids(coder, " ".join(words[k : k + 8000]))
    gc.collect()
    held = pa.total_allocated_bytes() - held + tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80 * len(words)


def test_packing_passes_few_texts_at_once(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(packing, "staged", lambda df, name: seen.append(int(spark.conf.get(key))) or df)
    before = spark.conf.get(key)
    packing.pack_documents(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), vocabulary()).collect()
    assert seen[0] <= 1000 and spark.conf.get(key) == before


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([1, 7, 64, 1024]))
def test_round_trip(ids, block):
    words, offsets = simple8b.encode(np.asarray(ids, dtype=np.uint64), block)
    assert simple8b.decode(words, offsets, len(ids), block).tolist() == ids


def test_segment_decodes_single_blocks():
    whole = np.concatenate([np.arange(k, dtype="<u4") for k in (0, 5, 3000, 1)])
    seg = simple8b.Segment.load(simple8b.Segment.of([1, 2, 3, 4], [0, 5, 3000, 1], whole, block=64).dump())
    assert seg.ids().tolist() == whole.tolist() and seg.ids(700, 905).tolist() == whole[700:905].tolist()
    assert len(seg.words) * 8 < whole.nbytes


def test_token_files(spark, plain):
    rows = simple8b.token_files(spark.createDataFrame(odd_documents(), SCHEMA), vocabulary()).collect()
    start, want = 0, []
    for i, text, *_ in sorted((d for d in odd_documents() if d[0] is not None), key=lambda d: (d[0], d[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows)) == sorted(want)
    assert simple8b.token_files(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    got = {}
    for n, content in packing.shortest_pack_first(histogram, 64):
        assert n > 0 and sum(content) <= 64
        for size in content:
            got[size] = got.get(size, 0) + n
    assert got == histogram


def test_packing(spark, plain):
    docs = [*odd_documents(), *((100 + k, "same few words", "", "") for k in range(50))]
    rows = packing.pack_documents(spark.createDataFrame(docs, SCHEMA), vocabulary()).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for i, text, *_ in docs:
        if i in (None, 11):
            continue
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert len(by_doc[11]) == 2
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 50))
def test_packs_as_one_by_one(lengths, size):
    """Longest first, each into the pack with the fewest tokens of those that longer ones have opened, if it fits there, else into a new one; packs of as many tokens are alike."""
    packs = []
    for n in sorted(set(lengths), reverse=True):
        opened = []
        for _ in range(lengths.count(n)):
            k = min(range(len(packs)), key=lambda k: sum(packs[k]), default=None)
            if k is not None and sum(packs[k]) + n <= size:
                packs[k].append(n)
            else:
                opened.append([n])
        packs += opened
    histogram = {n: lengths.count(n) for n in lengths}
    got = [content for count, content in packing.shortest_pack_first(histogram, size) for _ in range(count)]
    assert sorted(sum(c) for c in got) == sorted(map(sum, packs)) and sorted(n for c in got for n in c) == sorted(lengths)
