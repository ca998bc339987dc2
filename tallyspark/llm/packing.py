"""Operator 10: pack token pieces into sequences, shortest pack first over the histogram of lengths.

Only the histogram, at most one number for each length up to the sequence length, is worked on by the driver. Packing patterns
are then joined back to the pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, lean, partitions, staged, text_arrays, texts
from .tokens import with_end, word_ids

LENGTH = 4096
#: Texts that Spark passes to Python at once, and bytes of text that are encoded at once.
ROWS = 1000
SLICE = 1 << 20


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """[(how many packs, the lengths in each)] that hold each length as often as ``histogram`` says.

    Lengths are placed longest first, each into the pack with the fewest tokens if it fits there, else into a new pack. Packs
    with the same content are counted, not listed, so the work depends on the lengths and not on the number of pieces.
    """
    heap: list[tuple[int, int]] = []  # (tokens in the pack, pattern)
    patterns: list[list] = []  # how many packs, content

    def add(count: int, content: tuple[int, ...], used: int) -> None:
        patterns.append([count, content])
        heapq.heappush(heap, (used, len(patterns) - 1))

    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        if not 0 < size <= length:
            raise ValueError(f"length {size} is not between 1 and {length}")
        left = histogram[size]
        while left:
            if not heap or heap[0][0] + size > length:
                add(left, (size,), size)
                break
            used, k = heapq.heappop(heap)
            count, content = patterns[k]
            took = min(count, left)
            if took < count:
                patterns[k][0] = count - took
                heapq.heappush(heap, (used, k))
                add(took, (*content, size), used + size)
            else:
                patterns[k][1] = (*content, size)
                heapq.heappush(heap, (used + size, k))
            left -= took
    return [(n, c) for n, c in patterns]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 2, length: int = LENGTH) -> DataFrame:
    """Pieces of at most ``length`` ids of each document: doc_id, start, length, ids_crc32, doc_tokens. A document is cut at multiples of ``length``;
    null and empty texts have the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for names, some in text_arrays(batches, SLICE):
            ids, bounds = with_end(*coder.encode(some), end_id)
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            sizes = np.diff(bounds)
            cuts = -(-sizes // length)
            of = np.repeat(np.arange(len(sizes)), cuts)
            start = (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
            took = np.minimum(length, sizes[of] - start)
            at = 4 * (bounds[:-1][of] + start)
            crc = [zlib.crc32(view[a : a + n]) for a, n in zip(at.tolist(), (4 * took).tolist())]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(start), pa.array(took), pa.array(crc, pa.int64()), pa.array(sizes[of])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(lean(cut, "tokens"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0 among those of the same length. A length that a large share of all pieces has is ranked in
    salted groups whose sizes are then summed, so no task holds a whole length."""
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(partitions(pieces.sparkSession)))
    salted = pieces.withColumn("salt", salt)
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    return salted.withColumn("nth", F.row_number().over(own) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth")).drop("salt", "nth", "base")


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (doc_id, start, length and others) with sequence_id, offset in it, and padded_length of the sequence: ``length`` but where the tokens are
    a power of two. Every piece lies in one sequence; offsets are gapless from 0. An empty table stays empty."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for count, content in shortest_pack_first(histogram, length):
        at, used = 0, sum(content)
        padded = used if used & (used - 1) == 0 else length
        for size in content:
            slots.setdefault(size, []).append((count, first, at, padded))
            at += size
        first += count
    keys, bases, ats, padded = [], [], [], []
    for size in sorted(slots):
        rank = 0
        for count, seq, at, pad in slots[size]:
            keys.append((size << 44) + rank)
            bases.append(seq - rank)
            ats.append(at)
            padded.append(pad)
            rank += count
    table = [np.asarray(x, dtype=np.int64) for x in (keys, bases, ats, padded)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, at, pad = table
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, (batch.column("length").to_numpy(zero_copy_only=False) << 44) + rank, side="right") - 1
            out = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(base[k] + rank), pa.array(at[k]), pa.array(pad[k])],
                [*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset", "padded_length"])

    df = ranked(pieces)
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "rank")
    return df.mapInArrow(lean(place, "tokens"), f"{kinds}, sequence_id long, offset long, padded_length long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 2, length: int = LENGTH) -> DataFrame:
    with arrow_rows(docs.sparkSession, ROWS):
        pieces = staged(token_pieces(docs, tokenizer, end_id, length), "op10-pieces")
    return pack(pieces, length)
