"""Operator 5: toxic passages as maximum-scoring segments of token log-odds.

Log-odds of words and word beginnings between toxic and clean training documents are shrunk by a Dirichlet prior in proportion
to the whole training corpus. What isn't clearly toxic scores a little below zero, so a linear scan finds all maximal segments
(Ruzzo and Tompa). Segment scores of clean documents follow an extreme-value law, whose parameters turn a document's segments
into evidence; a logistic curve over that evidence gives the score.

Words and beginnings are told by 64-bit hashes and counted over all training documents; the model holds those that are clearly toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_batch, lean, slices, staged, texts
from .wordhash import PART, Words, mixed, parts

#: Lengths in bytes of the word beginnings that are counted besides the word.
STEMS = (4, 5, 6, 7, 8)
#: Weight of the Dirichlet prior, in documents' words.
PRIOR = 2_000.0
#: Least z-value and number of toxic training documents of a word that counts as toxic.
SURE, SEEN = 3.5, 3
#: Highest log-odds that one word gives, and what a neutral word takes.
MOST, NEUTRAL = 9.0, 0.3
#: Labelled training documents whose segments calibrate the score; counts use all of them.
CALIBRATION_ROWS = 20_000
#: Segments below this part of a certain word's log-odds are not kept.
FLOOR = 1.0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of the words and of their beginnings that are shorter than the word, word by word for each kind."""
    size = words.end - words.begin
    keys, of = [words.hashes()], [np.arange(len(size))]
    for n in STEMS:
        longer = np.flatnonzero(size > n)
        keys.append(mixed((words.hashes(words.begin[longer] + n, longer) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)))
        of.append(longer)
    return np.concatenate(keys), np.concatenate(of)


def maximal_segments(at: list[int], scores: list[float], gap: float) -> list[tuple[float, int, int]]:
    """(score, first, last) of all maximal scoring segments of a sequence that holds ``scores`` at the places ``at`` and -``gap`` elsewhere, in linear time."""
    found: list[tuple[float, float, int, int]] = []  # total before, total at the end, first, last
    total, past = 0.0, -1
    for place, s in zip(at, scores):
        total -= gap * (place - past - 1)
        past = place
        left = total
        total += s
        if s <= 0:
            continue
        first, right = place, total
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k -= 1
            if k < 0 or found[k][1] >= right:
                break
            left, first = found[k][0], found[k][2]
            del found[k:]
        found.append((left, right, first, place))
    return [(r - lo, a, b) for lo, r, a, b in found]


@dataclass
class Model:
    #: Sorted hashes of what is clearly toxic, and its log-odds.
    keys: np.ndarray
    odds: np.ndarray
    #: Of the extreme-value law.
    rate: float = 1.0
    size: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, -2.0)

    def marked(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place, log-odds) of the toxic words, in order."""
        keys, of = features(words)
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0)
        maybe = np.zeros(1 << 16, dtype=bool)  # by the upper bits, as few words are toxic
        maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(keys >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[at] == keys[some]
        each = np.zeros(len(words.begin))
        np.maximum.at(each, of[some[same]], self.odds[at[same]])
        place = np.flatnonzero(each > 0)
        return place, each[place]

    def segments(self, texts: list[bytes]) -> list[tuple[int, list[tuple[float, int, int, int, int]]]]:
        """(words, segments as (score, first word, last word, begin and end byte)) of each text. A long text is cut into words part by part, its segments go over all."""
        out: list = [None] * len(texts)
        few = [k for k, t in enumerate(texts) if len(t) <= PART]
        words = Words.of([texts[k] for k in few])
        place, odds = self.marked(words)
        bounds = np.searchsorted(place, words.first)
        for j, k in enumerate(few):
            mine = slice(bounds[j], bounds[j + 1])
            out[k] = int(words.first[j + 1] - words.first[j]), self._found(place[mine] - words.first[j], odds[mine], words.begin[place[mine]] - words.offsets[j],
                words.end[place[mine]] - words.offsets[j])
        for k, text in enumerate(texts):
            if out[k] is None:
                n = at = 0
                held = []
                for part in parts(text):
                    words = Words.of([part])
                    place, odds = self.marked(words)
                    held.append((place + n, odds, words.begin[place] + at, words.end[place] + at))
                    n, at = n + len(words.begin), at + len(part)
                out[k] = n, self._found(*(np.concatenate(x) for x in zip(*held)))
        return out

    @staticmethod
    def _found(place: np.ndarray, odds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[float, int, int, int, int]]:
        nth = {int(p): k for k, p in enumerate(place.tolist())}
        got = maximal_segments(place.tolist(), odds.tolist(), NEUTRAL) if len(place) else []
        return [(s, a, b, int(begin[nth[a]]), int(end[nth[b]])) for s, a, b in got if s >= FLOOR]

    def evidence(self, n: int, found: list[tuple]) -> tuple[float, float]:
        """How far the best segment and all segments lie above what chance gives in ``n`` words."""
        if not found:
            return 0.0, 0.0
        chance = math.log(self.size * max(n, 1))
        each = [max(0.0, self.rate * s - chance) for s, *_ in found]
        return math.log1p(max(each)), math.log1p(sum(each))

    def score(self, n: int, found: list[tuple]) -> float:
        a, b = self.evidence(n, found)
        x = self.curve[0] * a + self.curve[1] * b + self.curve[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def weighed(counts: DataFrame, all_toxic: float, all_clean: float) -> DataFrame:
    """(key, odds): log-odds of what is clearly toxic, from counts of documents (key, toxic, clean) and their sums over all features."""
    prior = PRIOR * (F.col("toxic") + F.col("clean")) / max(1.0, all_toxic + all_clean)
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y1 / (all_toxic + PRIOR - y1)) - F.log(y0 / (all_clean + PRIOR - y0))
    sure = counts.where(F.col("toxic") >= SEEN).select("key", odds.alias("odds"), F.sqrt(1 / (y1 + 0.5) + 1 / (y0 + 0.5)).alias("error"))
    return sure.where(F.col("odds") / F.col("error") >= SURE).select("key", F.least("odds", F.lit(MOST)).alias("odds"))


def held_features(raw: bytes) -> np.ndarray:
    """The different features of a text, part by part, so that a long text's features are held once."""
    found = np.zeros(0, np.uint64)
    for part in parts(raw):
        found = np.union1d(found, features(Words.of([part]))[0])
    return found


def calibrated(model: Model, n: np.ndarray, found: list[list[tuple]], y: np.ndarray) -> Model:
    """Extreme-value parameters from clean documents, by moments, then the curve."""
    best = np.asarray([max((s for s, *_ in f), default=0.0) for f in found])
    clean = best[y == 0]
    spread = clean.std() if len(clean) > 1 else 0.0
    model.rate = float(np.clip(math.pi / math.sqrt(6) / max(spread, 1e-9), 0.2, 2.0))
    logs = np.log(np.maximum(n[y == 0], 1))
    model.size = float(np.exp(np.clip(model.rate * clean.mean() - 0.5772 - logs.mean() if len(clean) else 0.0, -20, 0)))
    if len(y) and 0 < y.sum() < len(y):
        model.curve = tuple(logistic(np.asarray([model.evidence(int(k), f) for k, f in zip(n, found)]), y))
    elif len(y):
        model.curve = (0.0, 0.0, 3.0 if y.all() else -3.0)
    return model


def fit(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, toxic 0/1). Counts are of documents that hold a word, of whatever length. Only what is clearly toxic reaches the driver and the model: it grows
    with the vocabulary of toxic passages."""
    labelled = staged(labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "op5-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            keys, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, *(np.bincount(where, np.concatenate([h[k] for h in held]), len(keys)).astype(np.int64) for k in (1, 2))

        for batch in batches:
            for part in cut_batch(batch, "text"):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                label = part.column("toxic").to_numpy(zero_copy_only=False)
                words = Words.of([b"" if len(r) > PART else r for r in raw])
                keys, of = features(words)
                text = words.text[of]
                order = np.lexsort((text, keys))
                keys, text = keys[order], text[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
                own = [(keys[new], label[text[new]] if new.any() else np.zeros(0, int))]
                own += [(found := held_features(r), np.full(len(found), label[k])) for k, r in enumerate(raw) if len(r) > PART]
                for found, is_toxic in own:
                    held.append((found, is_toxic == 1, is_toxic == 0))
                    size += len(found)
                    if size > 1 << 20:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > 1 << 19:
                            yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), *map(pa.array, held[0][1:])], ["key", "toxic", "clean"])
                            held, size = [], 0
        if held:
            last = merged()
            yield pa.RecordBatch.from_arrays([pa.array(last[0].view(np.int64)), *map(pa.array, last[1:])], ["key", "toxic", "clean"])

    counts = labelled.mapInArrow(lean(count), "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = staged(counts, "op5-counts")
    whole = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    n1, n0 = float(whole["toxic"] or 0), float(whole["clean"] or 0)
    toxic = weighed(counts, n1, n0).toArrow()
    keys = toxic.column("key").to_numpy().view(np.uint64)
    model = Model(np.sort(keys), toxic.column("odds").to_numpy()[np.argsort(keys)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, "text"):
                got = model.segments([(t or "").encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([g[0] for g in got], pa.int64()),
                    pa.array([[s for s, *_ in g[1]] for g in got], pa.list_(pa.float64()))], ["doc_id", "toxic", "n", "scores"])

    some = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)  # small enough to broadcast
    scanned = labelled.join(F.broadcast(some), "doc_id").mapInArrow(lean(scan), "doc_id long, toxic int, n long, scores array<double>")
    once = scanned.groupBy("doc_id").agg(F.min(F.struct("toxic", "n", "scores")).alias("r"))  # a document that rows repeat is taken once
    rows = once.orderBy("doc_id").select("r.*").toArrow()
    found = [[(s,) for s in x] for x in rows.column("scores").to_pylist()]
    return calibrated(model, rows.column("n").to_numpy(), found, rows.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), passages (begin and end byte in the UTF-8 text, score) of every row of ``docs``. Null and empty texts have no passage and get
    the score of a text without evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in slices(batches, 1 << 20):
            got = model.segments([t.encode() for t in some])
            spans = [[{"begin": begin, "end": end, "score": float(s)} for s, _, _, begin, end in found] for _, found in got]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model.score(n, f) for n, f in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, score double, passages array<struct<begin:long,end:long,score:double>>")


def part_of(doc_id: Column, parts: int) -> Column:
    """The remainder of crc32 of the id as text, by which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of every document; labels are learnt from those not held out. Labels that are null or of unknown
    documents are left out; without any, all documents get the same low score."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = part_of(F.col("doc_id"), 3) == 1
    # Merged at every size, not broadcast where labels happen to be few: labels grow with the documents.
    model = fit(texts(docs).where(~held).join(known.hint("merge"), "doc_id"))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
