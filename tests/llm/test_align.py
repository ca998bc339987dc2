import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import align, queries
from tallyspark.llm.common import work_dir

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair string, n string"
NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND), align.Pair(FIRST, SECOND)


def spans(ids, of):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(of[i])))
        at = out[-1][2]
    return out


def one(text, tokenizers):
    """(a, b, groups, links) of a whole text, by walking both rows of tokens."""
    a, b, pair = tokenizers
    raw = (" " + (text or "")).encode()
    left, right = spans(a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.a_bytes), spans(b.encode(text or ""), pair.b_bytes)
    if not text or b"".join(pair.a_bytes[i] for i, *_ in left) != raw or b"".join(pair.b_bytes[i] for i, *_ in right) != raw:
        return None
    links = [(i, j) for i, p, q in left for j, r, s in right if max(p, r) < min(q, s)]
    groups, last = [], 0
    for end in sorted({q for _, _, q in left} & {q for _, _, q in right}):
        groups.append(tuple([i for i, _, q in side if last < q <= end] for side in (left, right)))
        last = end
    return left, right, groups, links


def brute(docs, tokenizers, products=False):
    got = [(i, one(t, tokenizers)) for i, t in docs if i is not None]
    links = lambda g: [(i, j) for x, y in g[2] for i in x for j in y] if products else g[3]
    counts = Counter(p for _, g in got if g for p in set(links(g)))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    rows = []
    for i, g in got:
        if g is None:
            rows.append((i, *NONE))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g[2])
        of = links(g)
        rows.append((i, len(g[0]), len(g[1]), len(g[2]), len(of), sum(counts[p] == best[p[0]] for p in of), sum(counts[p] for p in of), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(rows)


def odd():
    rng = random.Random(11)
    signs = ["the", "naïve", "Über", "日本語", "🙂", " ", "  ", "\n", "\t", "\r\n", " ", "it's", "42", "...", "</s>", "<|endoftext|>", "<0x0A>", "\x01", "\x1c", "é"]
    docs = [(k, "".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, " "), (103, "\n"), (104, "a▁b and a blank"), (105, "same text"), (105, "same text"), (106, "same text "), (None, "nobody has this"), (107, "words and words\n" * 300)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)


def result(df):
    return sorted(tuple(r)[:8] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("products", [False, True])
def test_equal_to_whole_texts(spark, tokenizers, products):
    docs = odd()
    assert result(align.aligned(frame(spark, docs), FIRST, SECOND, products)) == brute(docs, tokenizers, products)


def test_parts_and_memory_change_nothing(spark, tokenizers, monkeypatch):
    docs = [(i, t) for i, t in odd() if i is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])

    def counted():
        total, rows = Counter(), 0
        known = [align.Chunks(tokenizers[2], False)]
        first = known[0]
        sizes = {}
        for chunks, parts in align._documents(iter([batch]), known):
            for name, numbers, last in parts:
                rows += last
                sizes[name] = sizes.get(name, 0) + chunks.sizes[numbers].sum(axis=0)
                total[name] += len(numbers)
        return rows, {k: v.tolist() for k, v in sizes.items()}, total, known[0] is first

    whole = counted()
    monkeypatch.setattr(align, "PART", 40)
    monkeypatch.setattr(align, "REMEMBERED", 30)
    monkeypatch.setattr(align, "TOGETHER", 3)
    text = docs[-1][1]
    assert "".join(c for part in align.pieces(" " + text) for c in part) == " " + text and len(list(align.pieces(text))) > 50
    parted = counted()
    assert whole[:3] == parted[:3] and whole[0] == len(docs) and whole[3] and not parted[3]


def test_small_shards(spark, monkeypatch):
    rows = [((a << align.BITS) + b, (a * b) % 7 + 1) for a in range(30) for b in range(1 + a % 5)]
    counts = spark.createDataFrame(rows, "pair long, n long")
    shards = align.write_shards(counts, work_dir(spark, "shards"), size=4)
    got = align.looked_up(shards, np.asarray([p for p, _ in rows]))
    best = {}
    for p, n in rows:
        best[p >> align.BITS] = max(n, best.get(p >> align.BITS, 0))
    assert len(shards) > 5 and got.tolist() == [[n, int(n == best[p >> align.BITS])] for p, n in rows]


def test_no_documents(spark):
    assert result(align.aligned(frame(spark, []), FIRST, SECOND)) == []
    assert result(align.aligned(frame(spark, [(1, None), (2, "")]), FIRST, SECOND)) == [(1, *NONE), (2, *NONE)]


def test_query_equals_brute_force(spark, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in docs]
    got = result(queries.op11_align(spark, "/root/testdata/sf0.001"))
    short = [(i, t) for i, t in docs if len(t or "") < 1500]
    ours = {r[0]: r for r in got}
    assert len(got) == len(docs)
    for i, t in short:
        g = one(t, tokenizers)
        assert ours[i][1:5] == (len(g[0]), len(g[1]), len(g[2]), len(g[3]))
