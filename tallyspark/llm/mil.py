"""Operator 2: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by its words, hashed to ``WORDS`` places, by shape
statistics of its characters, and a layer over both; gated attention (a tanh branch times a sigmoid branch) weighs the passages; the weighted sum is scored. All
layers are learnt together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_batch, lean, slices, staged, texts
from .toxic import part_of
from .wordhash import PART, Words, parts

PASSAGE = 64
#: Labelled documents that the layers are learnt from, all passages of each, and passages beyond which no further document is taken: the driver holds 1,080 bytes of each.
SAMPLE, MOST_PASSAGES = 4_000, 200_000
HIDDEN, GATE = 16, 8
#: Places of hashed words; two words share one with a chance of 1 / WORDS, and the layer learns what a place says about quality.
WORDS = 256
#: How strongly the weights of shapes and of words are held near zero. That of words is the one of 0.001, 0.003, 0.01, 0.03 and 0.1 with the least log loss on a fifth of the training rows
#: (those whose crc32 of the id, divided by 4, is a multiple of 5), learnt from the others.
DECAY_SHAPE, DECAY_WORDS = 1e-5, 1e-2
EPOCHS, RATE = 120, 0.03

#: Classes of bytes.
LOWER, UPPER, DIGIT, BLANK, LINE, HIGH, STOP, SYMBOL, BANG, OTHER = range(10)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
for _c, _of in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t\r\x0b\x0c", BLANK), (b"\n", LINE),
    (bytes(range(128, 256)), HIGH), (b".,", STOP), (b"#*$%&|<>", SYMBOL), (b"!", BANG)):
    _CLASS[list(_c)] = _of
SHAPES = 14
FEATURES = SHAPES + WORDS


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, FEATURES) and each text's first passage, with the end. A text without words is one passage; a long text is encoded part by part."""
    if all(len(t) <= PART for t in texts):
        return _encoded(texts)
    each = [_encoded_long(t) if len(t) > PART else _encoded([t])[0] for t in texts]
    return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))


def _encoded_long(text: bytes) -> np.ndarray:
    """Passages of one text, as of the whole. Behind the last whole passage of a part, its words go to the next part; the classes of the signs and blanks behind them, or before the
    text's first word, are counted and added to the passage that they stand in."""
    out, rest, n, aside = [], b"", 0, np.zeros(10)
    for part in parts(text, PART):
        rest += part
        words = Words.of([rest])
        if not len(words.begin):
            aside, rest = aside + np.bincount(_CLASS[words.raw[:-1]], minlength=10), b""
            continue
        whole = (len(words.begin) - 1) // PASSAGE  # the last one may go on
        if whole:
            cut = int(words.begin[whole * PASSAGE])
            out.append(_encoded([rest[:cut]], aside)[0])
            n, rest, aside = n + whole * PASSAGE, rest[cut:], np.zeros(10)
            words = Words.of([rest])
        end = int(words.end[-1])
        if len(rest) - end > 1:
            aside = aside + np.bincount(_CLASS[words.raw[end:-1]], minlength=10)
            aside[BLANK] -= 1  # for the one that stands for them
            rest = rest[:end] + b" "
    n += len(Words.of([rest]).begin)
    out.append(_encoded([rest], aside)[0])
    x = np.concatenate(out)
    x[:, SHAPES - 1] = np.log1p(n)
    return x


def _encoded(texts: list[bytes], aside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``aside``: bytes by class that belong to the first passage and don't stand in the texts."""
    words = Words.of(texts)
    per = np.diff(words.first)
    count = np.maximum(1, -(-per // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(count)))
    total = int(bounds[-1])
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(total) - bounds[:-1][owner]
    if not total:
        return np.zeros((0, FEATURES), np.float32), bounds
    first_word = words.first[:-1][owner] + nth * PASSAGE
    begin = np.where(nth == 0, words.offsets[:-1][owner], words.begin[np.minimum(first_word, max(0, len(words.begin) - 1))] if len(words.begin) else 0)
    kinds = _CLASS[words.raw]
    kinds[words.offsets[1:] - 1] = 255  # what stands between texts is of none
    by_class = np.stack([np.add.reduceat(kinds == k, begin, dtype=np.int64) for k in range(10)], axis=1).astype(float)
    if aside is not None:
        by_class[0] += aside
    size = np.maximum(1.0, by_class.sum(axis=1))
    passage = bounds[:-1][words.text] + (np.arange(len(words.text)) - words.first[:-1][words.text]) // PASSAGE
    n = np.bincount(passage, minlength=total).astype(float)
    some = np.maximum(1.0, n)
    hashes = words.hashes()
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=total)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    letters = np.maximum(1.0, by_class[:, LOWER] + by_class[:, UPPER] + by_class[:, HIGH])
    place = passage * WORDS + (hashes >> np.uint64(40)).astype(np.int64) % WORDS
    said = np.bincount(place, minlength=total * WORDS).reshape(total, WORDS)
    shape = np.stack(
        [
            by_class[:, UPPER] / letters,
            np.log1p(by_class[:, SYMBOL] / some),
            np.log1p(by_class[:, BANG] / some),
            np.log1p(by_class[:, OTHER] / some),
            np.log1p(by_class[:, STOP] / some),
            by_class[:, DIGIT] / size,
            by_class[:, BLANK] / size,
            by_class[:, LINE] / size,
            by_class[:, HIGH] / size,
            np.log(letters / some),
            distinct / some,
            np.bincount(passage, weights=again, minlength=total) / some,
            np.log1p(n),
            np.log1p(per[owner]),
        ],
        axis=1,
    )
    return np.hstack((shape, np.sqrt(said / some[:, None]))).astype(np.float32), bounds


def _layers(x: np.ndarray, of: np.ndarray, docs: int, p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ p["w"].astype(np.float32) + p["b"])  # passages stay as they are: a copy in doubles would be twice as large
    tan, sig = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
    e = (tan * sig) @ p["a"]
    a = np.exp(e - e.max(initial=0.0))
    a /= np.maximum(np.bincount(of, a, minlength=docs), 1e-300)[of]
    z = np.stack([np.bincount(of, a * h[:, k], minlength=docs) for k in range(h.shape[1])], axis=1)
    return h, tan, sig, a, z, z @ p["c"] + p["d"]


def _scaled(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean.astype(np.float32)) / std.astype(np.float32), -8, 8)


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> dict[str, np.ndarray]:
    """Scaling and layers from passages, each document's first passage (with the end) and its label 0 or 1."""
    docs = len(y)
    of = np.repeat(np.arange(docs), np.diff(bounds))
    mean, std = (x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    std = np.where(std > 1e-9, std, 1.0)
    std[SHAPES:] = np.maximum(std[SHAPES:], 0.05)  # rare words don't stand out by being rare
    x = _scaled(x, mean, std)
    decay = np.append(np.full(SHAPES, DECAY_SHAPE), np.full(WORDS, DECAY_WORDS))[:, None]
    rng = np.random.default_rng(seed)
    p = {n: rng.normal(0, 0.3, s) for n, s in (("w", (FEATURES, HIDDEN)), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("a", GATE), ("c", HIDDEN))}
    p["w"][SHAPES:] /= 4
    p["b"], p["d"] = np.zeros(HIDDEN), np.zeros(1)
    if docs == 0:
        return p | {"mean": mean, "std": std}
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    for t in range(1, epochs + 1):
        h, tan, sig, a, z, logit = _layers(x, of, docs, p)
        up = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / docs
        dz = np.outer(up, p["c"])[of]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.bincount(of, a * da, minlength=docs)[of])
        gate = np.outer(de, p["a"])
        d_tan, d_sig = gate * sig * (1 - tan**2), gate * tan * sig * (1 - sig)
        dh = (a[:, None] * dz + d_tan @ p["v"].T + d_sig @ p["u"].T) * (1 - h**2)
        grads = {"w": x.T @ dh.astype(np.float32), "b": dh.sum(axis=0), "v": h.T @ d_tan, "u": h.T @ d_sig, "a": (tan * sig).T @ de, "c": z.T @ up, "d": np.asarray([up.sum()])}
        for n, g in grads.items():
            g = g + (decay if n == "w" else DECAY_SHAPE) * p[n]
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            p[n] = p[n] - RATE * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
    return p | {"mean": mean, "std": std}


def predict(model: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of each document, attention of each passage)."""
    docs = len(bounds) - 1
    of = np.repeat(np.arange(docs), np.diff(bounds))
    *_, a, _, logit = _layers(_scaled(x, model["mean"], model["std"]), of, docs, model)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), a


def fit(docs: DataFrame, known: DataFrame, sample: int = SAMPLE, most: int = MOST_PASSAGES) -> dict[str, np.ndarray]:
    """A model from ``docs`` (doc_id, text) and ``known`` (doc_id, label), whose first ``sample`` ids by hash are used, as far as they have no more than ``most`` passages
    together; the first is always taken."""
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # small enough to broadcast

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, "text"):
                x, bounds = encode([(t or "").encode() for t in part.column("text").to_pylist()])
                rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    each = docs.join(F.broadcast(few), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(lean(passages), "doc_id long, label int, x binary")
    once = each.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r"))  # a document that rows repeat is taken once
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of a few thousand numbers
    once = staged(once.select("doc_id", "r.*"), "op2-passages")
    held = F.sum(F.octet_length("x") / (4 * FEATURES)).over(order)
    fits = once.select("doc_id", held.alias("held"), F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("k")).where((F.col("held") <= most) | (F.col("k") == 1))
    got = once.join(F.broadcast(fits.select("doc_id")), "doc_id").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(np.int64)
    return train(np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32), bounds, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score, attention (weight of each passage) of every row of ``docs``; null and empty texts are one empty passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in slices(batches, 1 << 20):
            x, bounds = encode([t.encode() for t in some])
            s, a = predict(model, x, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(a))], ["doc_id", "score", "attention"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, score double, attention array<double>")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, attention of every document; labels of documents that are not held out teach the model. Null labels and labels of
    unknown documents are left out; without any, an untrained model scores around one half."""
    held = part_of(F.col("doc_id"), 4) == 2
    known = labels.where("doc_id is not null and quality is not null").where(~held).groupBy("doc_id").agg(F.min("quality").alias("label"))
    scored = score(docs, fit(texts(docs), known))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "attention")
