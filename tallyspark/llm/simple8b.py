"""Operator 1: token ids in word-aligned Simple-8b files.

A word of 64 bits holds a selector in its upper four bits and as many ids as the selector says in the lower sixty. Selector 0
is an escape: the next word holds one id of up to 64 bits. Ids are coded in blocks; the offset of each block's first word is
stored, so blocks can be decoded alone, and many at once by whole-array operations.

File: MAGIC, then unsigned 64-bit numbers (block length, documents, ids, blocks, words), doc_id of each document (signed 64
bits), its number of ids, word offset of each block and one of the end, words. All little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fetch, lean, partitions, put, staged, text_arrays, texts, work_dir
from .tokens import with_end, word_ids

MAGIC = b"TSIM8B01"
#: Ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
WIDEST = max(COUNTS)
BLOCK = 1024
#: Ids after which a file is closed.
SEGMENT = 1 << 22
#: Blocks that are coded together.
LANES = 512

_COUNTS = np.asarray(COUNTS, dtype=np.int64)


def _encode_lanes(rows: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the blocks in ``rows`` (padded with zeros by WIDEST at least) one after another, and the number of words of each."""
    lanes, width = rows.shape[0], rows.shape[1] - WIDEST
    best = np.zeros((lanes, width), dtype=np.uint8)
    top = int(rows.max()) if rows.size else 0
    for sel in range(len(COUNTS) - 1, 0, -1):
        count, bits = COUNTS[sel], BITS[sel]
        if top >> bits == 0:
            best[:] = sel
            continue
        over = np.zeros((lanes, width + count), dtype=np.int32)
        np.cumsum(rows[:, : width + count - 1] >> np.uint64(bits) != 0, axis=1, out=over[:, 1:])
        best[over[:, count:] == over[:, :width]] = sel
    at = np.zeros(lanes, dtype=np.int64)
    lane = np.arange(lanes)
    where, which = [], []
    live = lane[filled > 0]
    while live.size:
        pos = at[live]
        sel = best[live, pos]
        where.append(live * rows.shape[1] + pos)
        which.append(sel)
        at[live] = pos = pos + _COUNTS[sel]
        live = live[pos < filled[live]]
    if not where:
        return np.zeros(0, np.uint64), np.zeros(lanes, np.int64)
    flat_at = np.concatenate(where)
    order = np.argsort(flat_at, kind="stable")
    flat_at, sels = flat_at[order], np.concatenate(which)[order]
    size = 1 + (sels == 0)
    slot = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    flat = rows.reshape(-1)
    for sel in np.unique(sels).tolist():
        mine = sels == sel
        if sel == 0:
            words[slot[mine] + 1] = flat[flat_at[mine]]
            continue
        count, bits = COUNTS[sel], BITS[sel]
        word = np.full(int(mine.sum()), sel << 60, dtype=np.uint64)
        begin = flat_at[mine]
        for k in range(count):
            word |= flat[begin + k] << np.uint64(k * bits)
        words[slot[mine]] = word
    return words, np.bincount(flat_at // rows.shape[1], weights=size, minlength=lanes).astype(np.int64)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end) of unsigned ids of up to 64 bits."""
    ids = np.asarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // block)
    words, sizes = [], []
    for k in range(0, blocks, LANES):
        part = ids[k * block : (k + LANES) * block]
        lanes = -(-len(part) // block)
        rows = np.zeros((lanes, block + WIDEST), dtype=np.uint64)
        full = len(part) // block
        rows[:full, :block] = part[: full * block].reshape(full, block)
        rows[full:, : len(part) - full * block] = part[full * block :]
        filled = np.full(lanes, block)
        if full < lanes:
            filled[-1] = len(part) - full * block
        w, n = _encode_lanes(rows, filled)
        words.append(w)
        sizes.append(n)
    offsets = np.zeros(blocks + 1, dtype=np.uint64)
    if blocks:
        offsets[1:] = np.cumsum(np.concatenate(sizes))
    return np.concatenate(words) if words else np.zeros(0, np.uint64), offsets


def _payloads(sels: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words hold an escaped id. Only blocks with a selector 0 are walked."""
    out = np.zeros(len(sels), dtype=bool)
    zeros = np.flatnonzero(sels == 0)
    for b in np.unique(np.searchsorted(offsets, zeros, side="right") - 1).tolist():
        k, end = int(offsets[b]), int(offsets[b + 1])
        while k < end:
            if sels[k] == 0:
                out[k + 1] = True
                k += 1
            k += 1
    return out


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """All ids of the blocks that ``offsets`` bounds; ``n`` ids in all, each block full but the last."""
    blocks = len(offsets) - 1
    out = np.zeros(blocks * (block + WIDEST), dtype=np.uint64)
    offsets = offsets.astype(np.int64) - int(offsets[0])
    sels = (words >> np.uint64(60)).astype(np.int64)
    held = _payloads(sels, offsets) if (sels == 0).any() else np.zeros(len(words), bool)
    counts = np.where(held, 0, _COUNTS[np.where(held, 0, sels)])
    before = np.cumsum(counts) - counts
    of = np.repeat(np.arange(blocks), np.diff(offsets))
    if len(words):
        begin = before - before[np.minimum(offsets[:-1], len(words) - 1)][of] + of * (block + WIDEST)
    for sel in np.unique(sels[~held]).tolist():
        mine = np.flatnonzero((sels == sel) & ~held)
        if sel == 0:
            out[begin[mine]] = words[mine + 1]
            continue
        bits = BITS[sel]
        mask = np.uint64((1 << bits) - 1)
        for k in range(COUNTS[sel]):
            out[begin[mine] + k] = words[mine] >> np.uint64(k * bits) & mask
    return out.reshape(blocks, block + WIDEST)[:, :block].reshape(-1)[:n]


@dataclass
class Segment:
    """One file: documents in order and their ids."""

    doc_ids: np.ndarray
    sizes: np.ndarray
    block: int
    offsets: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> Segment:
        words, offsets = encode(ids, block)
        return cls(np.asarray(doc_ids, dtype="<i8"), np.asarray(sizes, dtype="<u8"), block, offsets, words)

    def dump(self) -> bytes:
        head = np.asarray([self.block, len(self.doc_ids), int(self.sizes.sum()), len(self.offsets) - 1, len(self.words)], dtype="<u8")
        return MAGIC + head.tobytes() + b"".join(x.astype(t).tobytes() for x, t in ((self.doc_ids, "<i8"), (self.sizes, "<u8"), (self.offsets, "<u8"), (self.words, "<u8")))

    @classmethod
    def load(cls, raw: bytes) -> Segment:
        if raw[:8] != MAGIC:
            raise ValueError("not a Simple-8b segment")
        block, docs, _, blocks, n_words = np.frombuffer(raw, "<u8", 5, 8).tolist()
        at = 48
        parts = []
        for kind, n in (("<i8", docs), ("<u8", docs), ("<u8", blocks + 1), ("<u8", n_words)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += 8 * n
        return cls(parts[0], parts[1], block, parts[2], parts[3])

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the file; only their blocks are decoded."""
        total = int(self.sizes.sum())
        end = total if end is None else min(end, total)
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, -(-end // self.block)
        offsets = self.offsets[first : last + 1]
        n = min(total, last * self.block) - first * self.block
        out = decode(self.words[int(offsets[0]) : int(offsets[-1])], offsets, n, self.block)
        return out[begin - first * self.block : end - first * self.block].astype(np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, segment: int = SEGMENT) -> DataFrame:
    """Write ``docs`` (doc_id, text) to files below ``folder`` in ascending doc_id order; returns (part, seq, path, before, n_docs, n_ids), a row for each
    file, where ``before`` counts the ids of earlier files of the same part.

    Null and empty texts have the end id alone. Rows with the same doc_id stand side by side, ordered by text. An empty table gives no file.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), word_ids(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = before = seq = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, before, seq
            path = f"{folder}/part-{part:06d}-{seq:05d}.s8b"
            names, sizes, ids = (np.concatenate(x) for x in zip(*held))
            put(path, Segment.of(names, sizes, ids).dump())
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "before": [before], "n_docs": [len(names)], "n_ids": [size]})
            before, seq, held, size = before + size, seq + 1, [], 0
            return row

        for names, some in text_arrays(batches, 1 << 23):
            ids, bounds = with_end(*coder.encode(some), end_id)
            held.append((names.to_numpy(zero_copy_only=False), np.diff(bounds), ids))
            size += len(ids)
            if size >= segment:
                yield close()
        if held:
            yield close()

    ordered = texts(docs).repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(lean(write, "tokens"), "part int, seq int, path string, before long, n_docs long, n_ids long"), "op1-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver holds a number for each part, not for each file or document."""
    spark = manifest.sparkSession
    base, total = {}, 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r["part"]] = total
        total += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment.load(fetch(row["path"]))
                sizes = seg.sizes.astype(np.int64)
                begins = np.cumsum(sizes) - sizes
                view = memoryview(seg.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(seg.doc_ids, pa.int64()), "start": pa.array(begins + base[row["part"]] + row["before"], pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return manifest.select("part", "path", "before").repartition(partitions(spark)).mapInArrow(lean(read, "tokens"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Write and read back: the operator's round trip."""
    folder = folder or work_dir(docs.sparkSession, "op1-tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id))
