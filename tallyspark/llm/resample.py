"""Operator 12: draw the documents that look most like a target set, by importance weights over hashed features and Gumbel noise.

Two counting passes give one array of gains, one for each bucket. Each document is scored against that array; what is drawn is the
head of the order (score downwards, then doc_id). That order is never made as a whole: every partition of scored documents writes
its eligible rows as sorted runs into the shared folder, keys taken from all runs cut the order into ranges, and each range is merged
from its slices of the runs by a tournament tree that stops at the exact draw count. The driver holds the gains, a count for each
different score, and one key of each ``STEP`` rows of the runs.

Cases: null and empty texts have no features, weight 0, and are never drawn. Rows without an id can't be named in a result; their
features count as the corpus's. Rows that share a doc_id are drawn each for itself, with the same score by n_features; rows that are equal in
all columns follow the order of the runs, so exactly the draw count is drawn. Texts are worked on in parts of a megabyte. An empty table gives an empty result, an
empty target gains from smoothing alone. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetch, lean, put, staged, work_dir
from .wordhash import LETTERS, parts

#: Rows of a sorted run, rows between two keys that a run names, such keys in a range, rows of a run that a merge holds at once.
RUN, STEP, RANGE, BLOCK = 1 << 20, 1 << 12, 64, 1 << 12
#: Buckets that a worker remembers by feature. Results don't depend on it.
REMEMBERED = 400_000
#: Lower case, and a blank for each byte that isn't of a word.
_WORDS = bytes(c or 32 for c in LETTERS.tolist())
#: Columns of a run: 64-bit, one row after another.
_RUN = ("score", "doc_id", "n_features", "weight")


class Buckets(dict):
    """Bucket of each feature, worked out when it is first met."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.size
        return out


def buckets_of(text: bytes, n: int, known: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of each part of a text. Features are all runs of 1 to ``n`` consecutive words."""
    tail: list[bytes] = []
    for part in parts(text):
        words = part.translate(_WORDS).split()
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if n > 1:
            held, near = len(tail), tail + words
            longer = [known[b" ".join(near[i + 1 - k : i + 1])] for k in range(2, n + 1) for i in range(max(held, k - 1), len(near))]
            out, tail = np.concatenate((out, np.asarray(longer, dtype=np.int64))), near[1 - n :]
        yield len(words), out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            yield name, text.as_py() or b""


def bucket_counts(df: DataFrame, n: int, size: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket. Each partition adds up its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = Buckets(size), np.zeros(size, np.int64)
        for _, text in _texts(batches):
            for _, found in buckets_of(text, n, known):
                out += np.bincount(found, minlength=size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["bucket", "n"])

    rows = df.select(F.lit(0).alias("k"), F.col(text_col).alias("text")).mapInArrow(lean(count), "bucket long, n long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, with one added to each count; floors go down."""
    size, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    of = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size))))
    return np.asarray([of(s, t) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Thousandths of a Gumbel draw that depends on the document's id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features), score (weight and noise)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = Buckets(len(gain)), []
        for name, text in _texts(batches):
            words = features = total = 0
            for count, found in buckets_of(text, n, known):
                words, features, total = words + count, features + len(found), total + int(gain[found].sum())
            weight = total // features if features else 0
            out.append((name, words, features, weight, weight + noise(name, seed)))
            if len(out) == 1 << 14:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(lean(score), "doc_id long, n_words long, n_features long, weight long, score long")


def write_runs(rows: DataFrame, folder: str, size: int = RUN, step: int = STEP) -> DataFrame:
    """Sorted runs of ``rows`` in ``folder``: run (its file's name), n, and the score, doc_id, n_features and place of every ``step``-th row. A repeated task writes the
    same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        k = total = 0
        task = TaskContext.get().partitionId()

        def run() -> pa.RecordBatch:
            table = np.concatenate(held)
            table = table[np.lexsort((table[:, 2], table[:, 1], -table[:, 0]))]
            put(f"{folder}/{(name := f'run-{task:07d}-{k:05d}')}", table.astype("<i8").tobytes())
            at = np.arange(0, len(table), step)
            keys = [pa.array([table[at, c].tolist()], pa.list_(pa.int64())) for c in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(table)]), *keys, pa.array([at.tolist()], pa.list_(pa.int64()))], ["run", "n", "scores", "ids", "features", "places"])

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _RUN], axis=1)
            while len(table):
                held.append(table[: size - total])
                table, total = table[size - total :], total + len(held[-1])
                if total == size:
                    yield run()
                    held, total, k = [], 0, k + 1
        if total:
            yield run()

    return rows.select(*_RUN).mapInArrow(lean(write), "run string, n long, scores array<long>, ids array<long>, features array<long>, places array<long>")


def _splitters(runs: list, every: int) -> list[tuple[tuple[int, int, int], str, int]]:
    """(key, run, place) that cut the merged order of all runs into ranges of about ``every`` named keys. Rows that tie are told apart by run and place, so a range is
    bounded whatever ties."""
    return sorted(((-s, i, f), r["run"], p) for r in runs for s, i, f, p in zip(r["scores"], r["ids"], r["features"], r["places"]))[every::every]


def _place(keys: list[np.ndarray], key: tuple[int, ...], side: str) -> int:
    """Where ``key`` stands among rows sorted by all of ``keys``."""
    low, high = 0, len(keys[0])
    for column, value in zip(keys, key):
        part = column[low:high]
        low, high = low + int(np.searchsorted(part, value, "left")), low + int(np.searchsorted(part, value, "right"))
    return high if side == "right" else low


def slices(runs: DataFrame, folder: str, splitters: list[tuple[tuple[int, int, int], str, int]]) -> DataFrame:
    """(range, run, low, high): the rows of each run that lie in each range."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                table = np.frombuffer(fetch(f"{folder}/{run}"), "<i8").reshape(-1, len(_RUN))
                keys = [-table[:, 0], table[:, 1], table[:, 2]]
                cuts = [place if run == other else _place(keys, key, "right" if run < other else "left") for key, other, place in splitters]
                at = np.asarray([0, *cuts, len(table)])
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([run] * len(full), pa.string()), pa.array(at[full]), pa.array(at[full + 1])], ["range", "run", "low", "high"])

    return runs.select("run").mapInArrow(lean(locate), "range long, run string, low long, high long")


def _blocks(uri: str, low: int, high: int) -> Iterator[np.ndarray]:
    """Rows ``low`` to ``high`` of a run, a block at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    width = 8 * len(_RUN)
    for at in range(low, high, BLOCK):
        with fs.open_input_file(path) as f:
            yield np.frombuffer(f.read_at(width * (min(at + BLOCK, high) - at), width * at), "<i8").reshape(-1, len(_RUN))


def _rows(blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
    for block in blocks:
        for score, name, features, weight in block.tolist():
            yield -score, name, features, weight


def tournament(runs: list[Iterator[tuple]], limit: int) -> Iterator[tuple]:
    """The first ``limit`` rows of sorted runs in order, the earlier run first where keys (the first three values) tie; then what is left, as it comes. A
    tree of matches keeps each match's loser, so the next row costs one comparison for each level."""
    heads = [next(r, None) for r in runs]
    k = len(runs)

    def beats(a: int, b: int) -> bool:
        return heads[b] is None or heads[a] is not None and (heads[a][:3], a) < (heads[b][:3], b)

    won, lost = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], lost[node] = (a, b) if beats(a, b) else (b, a)
    best = won[1] if k else 0
    while limit and k and heads[best] is not None:
        yield heads[best]
        limit -= 1
        heads[best] = next(runs[best], None)
        node = (k + best) // 2
        while node:
            if beats(lost[node], best):
                lost[node], best = best, lost[node]
            node //= 2
    yield from (h for h in heads if h is not None)
    for r in runs:
        yield from r


def merged(pieces: DataFrame, folder: str, draw: int) -> DataFrame:
    """All rows of the runs with their rank from 1 up to ``draw``, null beyond. Each range is merged by one task, which stops its tree at the draw count
    and passes the rest on as it comes."""
    sizes = pieces.groupBy("range").agg(F.sum(F.col("high") - F.col("low")).alias("n")).orderBy("range").collect()
    base, total = {}, 0
    for r in sizes:
        base[r["range"]], total = total, total + r["n"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.sort(key=lambda x: x["run"])
                sources = [_rows(_blocks(f"{folder}/{x['run']}", x["low"], x["high"])) for x in of]
                limit = max(0, draw - base[number])
                for out in _numbered(tournament(sources, limit), base[number], limit):
                    ranks = pa.array([x[4] for x in out], pa.int64())
                    cols = [pa.array([x[c] for x in out], pa.int64()) for c in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([-x[0] for x in out], pa.int64()), ranks], ["doc_id", "n_features", "weight", "score", "rank"])

    whole = pieces.groupBy("range").agg(F.collect_list(F.struct("run", "low", "high")).alias("of"))
    return whole.mapInArrow(lean(merge), "doc_id long, n_features long, weight long, score long, rank long")


def _numbered(rows: Iterator[tuple], base: int, limit: int, size: int = 1 << 14) -> Iterator[list[tuple]]:
    """``rows`` in lists, the first ``limit`` with ranks after ``base``, the others with none."""
    out: list[tuple] = []
    for k, row in enumerate(rows):
        out.append((*row, base + k + 1 if k < limit else None))
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, part: tuple[int, int] = (10, 100), seed: int = 2024) -> DataFrame:
    """Every document with doc_id, n_features, weight, score and rank: of the N documents with ``least_words`` words or more, ``part[0] * N // part[1]`` are
    drawn by score downwards, then by doc_id; the others' rank is null."""
    spark = docs.sparkSession
    rows = staged(scored(docs, gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)), n, seed), "op12-scores")
    eligible = F.col("n_words") >= least_words
    counts = rows.where(eligible).groupBy("score").agg(F.count("*").alias("k")).orderBy(F.desc("score")).collect()
    draw = part[0] * sum(r["k"] for r in counts) // part[1]
    if not draw:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    reached, least = 0, 0
    for r in counts:
        reached, least = reached + r["k"], r["score"]
        if reached >= draw:
            break
    folder = work_dir(spark, "op12-runs")
    head = eligible & (F.col("score") >= least)
    runs = staged(write_runs(rows.where(head), folder), "op12-run-list")
    cuts = _splitters(runs.collect(), RANGE)
    drawn = merged(staged(slices(runs, folder, cuts), "op12-slices"), folder, draw)
    return drawn.unionByName(rows.where(~head).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
