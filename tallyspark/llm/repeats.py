"""Operator 6: remove byte strings that occur earlier, by the suffixes of a collection sorted column by column.

A document's 100-byte windows are cut into pieces: consecutive windows with the same anchor, the least of a hash over the
window's grams. Equal windows have equal anchors, so only pieces under one anchor can share a window, and pieces under
an anchor that occurs once share none. Equal pieces under an anchor are one piece with a first place.

The pieces under one anchor are a collection whose suffixes are put in order by inserting one symbol of each piece per round,
from the last column to the first. Each round updates the Burrows-Wheeler transform and the common prefixes of neighbours by
passes over them in order. Windows that agree are then neighbours with a common prefix of 100 or more. A collection is read
from a table sorted by anchor, so what one task holds is bounded. Only windows around whose anchor another piece agrees are put in order, with the anchor's gram as one symbol. Pieces under an anchor that has more than ``HOT`` different ones aren't
put in order by one task: each of their windows is a row, and equal windows meet by two hashes in one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_batch, lean, number_filter, partitions, passing, staged, texts, work_dir

LENGTH = 100
GRAM = 32
#: Pieces whose suffixes are put in order together.
PIECES = 1_500
#: Ranges of places of the gram in a window, for which it is asked whether pieces agree around it.
STRETCHES = 8
#: Stands for the gram of an anchor; UTF-8 doesn't have this byte.
GRAM_SYMBOL = b"\xfe"
#: Different pieces that a collection under one anchor has at most.
HOT = 50_000
#: Bytes that are hashed at once.
STRIDE = 1 << 20
#: Windows, or bytes, that are worked on together, so that they stay in the cache of a core.
BLOCK = 1 << 15

_U = np.uint64
_RNG = np.random.default_rng(6)
_OF_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = {n: int(_RNG.integers(1, 2**62, dtype=np.uint64)) * 2 + 1 for n in (1, 2, 4, 8, 16, 32)}
_BASE = int(_RNG.integers(1, 2**62, dtype=np.uint64)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([_U(1)], np.cumprod(np.full(n, base, dtype=np.uint64))))


def _mixed(h: np.ndarray) -> np.ndarray:
    x = h >> _U(29)
    x ^= h
    x *= _U(0xBF58476D1CE4E5B9)
    h = x >> _U(32)
    h ^= x
    return h


def grams(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each ``gram`` bytes."""
    h, n = _OF_BYTE[raw], 1
    while n < gram:
        x = h[:-n] * _U(_STEP[n])
        x += h[n:]
        h, n = x, 2 * n
    return _mixed(h)


def anchors(raw: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes, the least hash of its grams, and whether its first gram has it."""
    width, windows = length - gram + 1, len(raw) - length + 1
    least, at_first = np.empty(windows, np.uint64), np.empty(windows, bool)
    for at in range(0, windows, BLOCK):
        h = grams(raw[at : at + BLOCK + length - 1], gram)
        low, n = h, 1
        while 2 * n <= width:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :]) if width > n else low
        least[at : at + BLOCK] = low
        np.equal(h[: len(low)], low, out=at_first[at : at + BLOCK])
    return least, at_first


def units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (doc_id, offset, bytes) of about ``STRIDE`` bytes. Longer texts come in parts that share ``length`` - 1 bytes, so each window is in one part."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = t.as_buffer().to_pybytes()
            for at in range(0, max(1, len(raw) - length + 1), STRIDE):
                part = raw[at : at + STRIDE + length - 1]
                held.append((i, at, part))
                size += len(part)
                if size >= STRIDE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def pieces(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(anchor, doc_id, first window, windows, place in the joined bytes) of the pieces, and the joined bytes."""
    sizes = np.asarray([len(b) for _, _, b in group])
    raw = np.frombuffer(b"".join(b for _, _, b in group), dtype=np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none, none, raw
    low, at_first = anchors(raw, length)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # A window's anchor stands at the first place where its least hash is found, so equal windows are never in one piece.
    new = np.ones(len(low), dtype=bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= at_first[:-1]
    new[starts[starts < len(low)]] = True
    begins = np.flatnonzero(new)
    of = np.searchsorted(ends, begins, side="right")
    stops = np.minimum(np.append(begins[1:], len(low)), ends[of] - length + 1)
    keep = stops > begins
    begins, stops, of = begins[keep], stops[keep], of[keep]
    first = np.asarray([o for _, o, _ in group])[of] + begins - starts[of]
    return low[begins], np.asarray([i for i, _, _ in group])[of], first, stops - begins, begins, raw


def sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`told` takes fingerprints of stretches of ``raw`` from."""
    most = 2 * (STRIDE + 4096)
    total, powers = np.zeros(len(raw) + 1, np.uint64), _powers(_BASE, most)
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), BLOCK):
            x = _OF_BYTE[raw[at : at + BLOCK]]
            x *= powers[at : at + len(x)]
            part = np.cumsum(x, out=total[at + 1 : at + 1 + len(x)])
            part += total[at]
    return total, _powers(_BACK, most)


def told(of: tuple[np.ndarray, np.ndarray], begins: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """64-bit fingerprints of stretches."""
    total, back = of
    with np.errstate(over="ignore"):
        return _mixed((total[begins + sizes] - total[begins]) * back[begins] + np.asarray(sizes, dtype=np.uint64))


def prints(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of stretches of ``raw``."""
    return told(sums(raw), begins, sizes)


def ordered_suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, common prefix with the one before up to 255, symbol before as byte + 1, 0 at a text's begin) of all suffixes in order, the empty ones first.

    Round j inserts the suffix of length j + 1 of each text that has one: its place follows from the symbol before the suffix of length j, as a
    stable order of the symbols is the order of the suffixes that they begin. That order of (symbol, place) is kept from round to round: row i of it is
    suffix m + i, so a round moves places on by what was inserted before them and merges the new rows in.
    """
    m = len(texts)
    sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)  # a byte that UTF-8 doesn't have
    symbols = joined + np.uint8(1)  # so a text's end, and what stands before its begin, is 0
    low, high = (1 << 48) - 1, 48
    common = np.zeros(m, dtype=np.uint8)
    rows = np.zeros(0, dtype=np.int64)
    at, place = begin + sizes, np.arange(m)  # of the newest suffixes, in order
    while True:
        on = symbols[at - 1]
        order = np.argsort(on, kind="stable")[np.count_nonzero(on == 0) :]
        if not len(order):
            break
        fresh = (on[order].astype(np.int64) << high) | place[order]
        mine = np.searchsorted(rows, fresh) + np.arange(len(fresh))
        kept = np.ones(m + len(rows) + len(fresh), dtype=bool)
        kept[m + mine] = False
        rows, old = np.empty(len(rows) + len(fresh), dtype=np.int64), rows
        rows[kept[m:]], rows[mine] = old, fresh
        # Neighbours of which one is new: one symbol more than the suffixes behind them, whose least common prefix is between.
        touched = np.stack((mine, mine + 1), axis=1).ravel()
        touched = touched[np.append(True, touched[1:] != touched[:-1])]
        touched = touched[(touched > 0) & (touched < len(rows))]
        left, right = rows[touched - 1], rows[touched]
        same = np.flatnonzero((left ^ right) >> high == 0)
        value = np.zeros(len(touched), np.uint8)
        if len(same):
            left, right = left[same] & low, right[same] & low
            by = np.argsort(left)
            pair = np.empty(2 * len(by), np.int64)
            pair[::2], pair[1::2] = left[by] + 1, right[by] + 1
            least = np.minimum.reduceat(np.append(common, np.uint8(0)), pair)[::2]
            value[same[by]] = np.minimum(least, 254) + np.uint8(1)
        common, old = np.empty(len(kept), np.uint8), common
        common[kept] = old
        common[m] = 0
        common[m + touched] = value
        at, place = at[order] - 1, m + mine
        inserted = np.repeat(np.arange(len(place) + 1), np.diff(np.concatenate(([0], place - np.arange(len(place)), [len(old)]))))
        rows += inserted[rows & low]
    before = np.zeros(len(common), np.uint8)
    behind = rows & low
    before[behind] = rows >> high
    follows = np.zeros(len(common), np.int64)
    follows[behind] = np.arange(m, len(common))
    text, start = np.empty(len(common), np.int64), np.empty(len(common), np.int64)
    place, of, at = np.arange(m), np.arange(m), sizes
    while len(place):
        text[place], start[place] = of, at
        on = before[place] != 0
        place, of, at = follows[place[on]], of[on], at[on] - 1
    return text, start, common, before


def shared(texts: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where its anchor's gram begins, least and most bytes before the gram) of the windows of each piece that another piece under its anchor may share; most is -1 if there are none.

    Equal windows have their anchor's gram in the same place, so a window with a to b bytes before the gram can only be shared by pieces that agree from a bytes before the gram to as
    many behind it as a window with b before it has.
    """
    span = length - GRAM
    step = max(1, -(-span // STRETCHES))
    ranges = [(a, min(a + step - 1, span)) for a in range(0, span + 1, step)]
    n = np.asarray([len(t) for t in texts], dtype=np.int64) - length + 1
    gram = np.zeros(len(texts), np.int64)
    keys: list[list[np.ndarray]] = [[] for _ in ranges]
    for k in range(0, len(texts), PIECES):
        raw, sizes, mine = np.frombuffer(b"".join(texts[k : k + PIECES]), dtype=np.uint8), n[k : k + PIECES] + length - 1, anchor[k : k + PIECES]
        begins = np.cumsum(sizes) - sizes
        h = grams(raw)
        of = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
        hit = np.flatnonzero(h.view(np.int64) == mine[of])
        of, hit = of[hit], hit - begins[of[hit]]
        of, hit = of[hit <= span], hit[hit <= span]
        first = np.append(True, of[1:] != of[:-1])
        gram[k + of[first]] = hit[first]
        total, here = sums(raw), gram[k : k + PIECES]
        for (a, b), found in zip(ranges, keys):
            has = np.flatnonzero((here >= a) & (here - n[k : k + PIECES] < b))
            found.append(told(total, begins[has] + here[has] - a, GRAM + span + a - b) ^ _mixed(mine[has].view(np.uint64)))
    least, most = np.full(len(texts), length), np.full(len(texts), -1)
    for (a, b), found in zip(ranges, keys):
        has = np.flatnonzero((gram >= a) & (gram - n < b))
        _, kinds, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        has = has[count[kinds] > 1]
        least[has] = np.minimum(least[has], np.maximum(a, gram[has] - n[has] + 1))
        most[has] = np.maximum(most[has], np.minimum(b, gram[has]))
    return gram, least, most


def repeated_windows(texts: list[bytes], anchor: np.ndarray, doc: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of windows that occur earlier, where text k under ``anchor[k]`` begins at byte ``first[k]`` of document ``doc[k]``.

    Only windows that may be shared are put in order. The gram of the anchor, which all of them have, is one symbol there; which gram it is, is compared with the place.
    """
    gram, least, most = shared(texts, anchor, length)
    some = np.flatnonzero(most >= 0)
    if not len(some):
        return some, some
    gram, least, most, doc, first = (x[some] for x in (gram, least, most, doc, first))
    cut = gram - most
    symbols = [texts[k][a:g] + GRAM_SYMBOL + texts[k][g + GRAM : z] for k, a, g, z in zip(some.tolist(), cut.tolist(), gram.tolist(), (gram + length - least).tolist())]
    which = np.unique(np.frombuffer(b"".join(texts[k][g : g + GRAM] for k, g in zip(some.tolist(), gram.tolist())), dtype=f"V{GRAM}"), return_inverse=True)[1]
    text, start, common, _ = ordered_suffixes(symbols)
    equal = common >= length - GRAM + 1
    equal[:-1] |= equal[1:]  # the first of equal ones too
    group = np.cumsum(common < length - GRAM + 1)
    has = np.flatnonzero(equal)
    text, start, group = text[has], start[has], group[has]
    doc, at = doc[text], (first + cut)[text] + start
    order = np.lexsort((at, doc, which[text], group))
    text, start, group, doc, at = (x[order] for x in (text, start, group, doc, at))
    lead = np.ones(len(text), dtype=bool)
    lead[1:] = (group[1:] != group[:-1]) | (which[text[1:]] != which[text[:-1]])
    own = np.maximum.accumulate(np.where(lead, np.arange(len(text)), 0))
    # The same place may stand in two texts: not a repeat of itself.
    late = np.flatnonzero((doc != doc[own]) | (at != at[own]))
    return some[text[late]], cut[text[late]] + start[late]


def spot(fingerprint: Column, doc: Column, first: Column) -> Column:
    """A number for a piece at a place, as the workers make it."""
    return fingerprint.bitwiseXOR(doc).bitwiseXOR(F.shiftleft(doc, 20)).bitwiseXOR(F.shiftleft(first, 9))


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted starts as runs [first, last]."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, begin, end) of bytes that windows with an earlier occurrence cover; spans of a document may overlap."""
    spark = docs.sparkSession
    docs = texts(docs)
    folder = work_dir(spark, "op6-filters")

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in units(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(pieces(group, length)[0].view(np.int64))], ["anchor"])

    often = docs.mapInArrow(lean(low), "anchor long").groupBy("anchor").count().where("count > 1")
    # A piece begins about every 35 bytes, so at most a 70th of the bytes is the number of anchors that two pieces have.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    common = number_filter(often, "anchor", f"{folder}/anchors", expected=size // 64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in units(batches, length):
            anchor, doc, first, n, at, raw = pieces(group, length)
            keep = passing(common, anchor)
            anchor, doc, first, n, at = (x[keep] for x in (anchor, doc, first, n, at))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(prints(raw, at, n + length - 1).view(np.int64)), pa.array(doc, pa.int64()),
                pa.array(first, pa.int64()), pa.array(n, pa.int32())], ["anchor", "print", "doc_id", "first", "n"])

    places = staged(docs.mapInArrow(lean(placed), "anchor long, print long, doc_id long, first long, n int"), "op6-places")
    whole = staged(places.groupBy("anchor", "print").agg(F.min(F.struct("doc_id", "first")).alias("lead"), F.count("*").alias("copies")), "op6-pieces")
    mixed = whole.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    split = staged(whole.join(mixed, "anchor").select("anchor", "print", "kinds", F.col("lead.doc_id").alias("doc_id"), F.col("lead.first").alias("first")), "op6-mixed")
    # Asked by piece and place, so of equal pieces hardly more than the first goes on.
    spots = number_filter(split.select(spot(F.col("print"), F.col("doc_id"), F.col("first")).alias("spot")), "spot", f"{folder}/mixed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in units(batches, length):
            anchor, doc, first, n, at, raw = pieces(group, length)
            keep = passing(spots, prints(raw, at, n + length - 1).view(np.int64) ^ doc ^ (doc << 20) ^ (first << 9))  # as ``spot`` has it
            anchor, doc, first, n, at = (x[keep] for x in (anchor, doc, first, n, at))
            held = raw.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc, pa.int64()), pa.array(first, pa.int64()),
                pa.array([held[a : a + k + length - 1] for a, k in zip(at.tolist(), n.tolist())], pa.binary())], ["anchor", "doc_id", "first", "bytes"])

    loaded = docs.mapInArrow(lean(cut), "anchor long, doc_id long, first long, bytes binary").join(split, ["anchor", "doc_id", "first"])
    few = F.col("kinds") <= hot

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(t: pa.Table) -> pa.RecordBatch:
            doc, first = (t.column(c).to_numpy() for c in ("doc_id", "first"))
            group = t.column("anchor").to_numpy()
            raw = t.column("bytes").to_pylist()
            rows: list[tuple] = []
            text, start = repeated_windows(raw, group, doc, first, length)
            order = np.lexsort((start, text))
            text, start = text[order], start[order]
            for k in np.unique(text).tolist():
                lo, hi = np.searchsorted(text, [k, k + 1])
                rows.append((int(group[k]), int(t.column("print")[k].as_py()), [{"begin": a, "end": b + length} for a, b in runs_of(start[lo:hi])]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], ["anchor", "print", "inside"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= PIECES:
                t = pa.Table.from_batches(held)
                group = t.column("anchor").to_numpy()
                edges = np.flatnonzero(group[1:] != group[:-1]) + 1
                ready = edges[edges >= PIECES]
                if not len(ready):  # one anchor goes on; it has at most ``hot`` pieces
                    break
                yield solve(t.slice(0, int(ready[0])))
                held = t.slice(int(ready[0])).combine_chunks().to_batches()
                size = len(group) - int(ready[0])
        if size:
            yield solve(pa.Table.from_batches(held))

    loaded = staged(loaded, "op6-bytes")
    inside = loaded.where(few).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(lean(sort), "anchor long, print long, inside array<struct<begin:long,end:long>>")
    late = staged(inside, "op6-inside")

    if not loaded.where(~few).isEmpty():
        late = late.unionByName(crowded(loaded.where(~few), length))

    # Written down, so that the join with all places stands alone and a group of very many copies can be split.
    known = staged(whole.join(late, ["anchor", "print"], "left").where("copies > 1 or inside is not null").select("anchor", "print", "lead", "inside"), "op6-known")
    hits = places.join(known, ["anchor", "print"])
    is_lead = F.struct("doc_id", "first") == F.col("lead")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("begin"), (F.col("n") + length - 1).cast("long").alias("end")))
    spans = hits.select("doc_id", "first", F.explode(F.when(is_lead, F.col("inside")).otherwise(all_of_it)).alias("s"))
    return spans.select("doc_id", (F.col("first") + F.col("s.begin")).alias("begin"), (F.col("first") + F.col("s.end")).alias("end"))


def crowded(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, print, inside) of pieces (anchor, print, doc_id, first, bytes) whose collections are too large to be put in order by one task: a row for each window, told by two
    64-bit hashes, and the first place of each. One round, however many pieces there are; a window that very many pieces share is counted before it is shuffled, and Spark
    splits its join."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, "bytes"):
                sizes = np.asarray([len(b) for b in part.column("bytes").to_pylist()], dtype=np.int64)
                raw = np.frombuffer(b"".join(part.column("bytes").to_pylist()), dtype=np.uint8)
                each = sizes - length + 1
                row = np.repeat(np.arange(len(sizes)), each)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                at = (np.cumsum(sizes) - sizes)[row] + offset
                wide = np.full(len(at), length)
                of = {c: part.column(c).to_numpy()[row] for c in ("anchor", "print", "doc_id", "first")}
                hashes = [prints(x, at, wide).view(np.int64) for x in (raw, raw ^ np.uint8(0x5A))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), *(pa.array(of[c]) for c in ("anchor", "print", "doc_id")), pa.array(of["first"] + offset), pa.array(offset)],
                    ["h", "g", "anchor", "print", "doc_id", "at", "offset"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"begin": a, "end": b + length} for a, b in runs_of(np.unique(x))] for x in batch.column("offsets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("print"), pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                ["anchor", "print", "inside"])

    windows = staged(rows.mapInArrow(lean(cut), "h long, g long, anchor long, print long, doc_id long, at long, offset long"), "op6-windows")
    lead = windows.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = windows.join(lead, ["h", "g"]).where(F.struct("doc_id", "at") != F.col("lead"))
    some = late.groupBy("anchor", "print").agg(F.collect_list("offset").alias("offsets"))
    return some.mapInArrow(lean(joined), "anchor long, print long, inside array<struct<begin:long,end:long>>")


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the spans of each row in order, with those that touch or overlap joined. Rows are below 2^22, ends below 2^40."""
    base = row.astype(np.int64) << 40
    order = np.argsort(base + begin, kind="stable")
    base, begin, end = base[order], begin[order], end[order]
    reach = np.maximum.accumulate(base + end)
    new = np.append(True, base[1:] + begin[1:] > reach[:-1])[: len(base)]
    last = np.append(new[1:], True)[: len(base)]
    return base[new] >> 40, begin[new], reach[last] - base[last]


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` of each document, whose bytes in a string of ``length`` bytes that also starts
    earlier (smaller doc_id, or earlier in the document) go.

    Null and empty texts have no bytes, texts shorter than ``length`` stay whole. A doc_id names one text: rows that repeat it are the same place and don't
    count as repeats of each other.
    """
    spans = repeated_spans(docs, length, hot).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("found"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            row = np.repeat(np.arange(batch.num_rows), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = found.flatten()
            row, begin, end = merged(row, flat.field("begin").to_numpy(), flat.field("end").to_numpy())
            runs, gone = np.bincount(row, minlength=batch.num_rows), np.zeros(batch.num_rows, np.int64)
            np.add.at(gone, row, end - begin)
            ends = np.cumsum(runs)
            sizes, kept = [], []
            for text, lo, hi in zip(batch.column("text"), (ends - runs).tolist(), ends.tolist()):
                raw = memoryview(text.as_buffer())
                digest, at = hashlib.sha256(), 0
                for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist()):
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                sizes.append(len(raw))
                kept.append(digest.hexdigest())
            removed = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone), pa.array(runs, pa.int64()), pa.array(kept, pa.string()), removed],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts(docs).join(spans, "doc_id", "left").mapInArrow(lean(strip), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>")
