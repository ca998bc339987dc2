"""Operator 9: near duplicates by bottom-k sketches from one hash function.

A document is the set of its word shingles, as 64-bit hashes. Equal sets form a class, and one document stands for it. The
``k`` smallest hashes of a set are its sketch. Inverted lists of retained values give candidate pairs, the sketch of the union
estimates their similarity, and the full sets decide.

Lists hold only what a similar pair can't avoid to share. Two sets of similarity 0.8 share at least ``least_shared`` retained
values (for sets no larger than the sketch by counting, else but for a chance below ``MISSED``), so among each sketch's values in
order of frequency, all but the ``least_shared - SEEN`` most frequent hold ``SEEN`` of them. Values that only one class has fill these
places first and need no list, so very frequent values hardly ever get one.

Lists of up to ``SHORT`` members give all their pairs; of those that meet in short lists only, the ones that meet ``SEEN`` times are candidates.
Longer lists are not expanded into pairs. Each document is first compared with one leader of each of its
long lists: the member with the least share of values of its own, which stands in the middle of a group and is linked with nearly all
of it. What lists then still hold of different components meets by its full sets, rarest values first. A value at place ``i`` of
``n`` leaves ``n - i`` values to share, so it reaches partners of up to ``(9 (n - i) - 4 n) / 4`` values only. Documents with many
values of their own don't even reach their own size, and meet few others or none, however large the group is. Before all these pairs are made, members outside a
value's main component are held against its few members with the fewest values of their own; what they join meets none of it any more.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, number_filter, passing, slices, staged, texts, work_dir
from .wordhash import PART, SPACED, Words, mixed, parts

SKETCH = 128
#: Chance at most that two sets of similarity 0.8 share fewer values, or have a lower estimate, than is asked for.
MISSED = 1e-9
#: Values that a similar pair shares at least in its lists, and members of a list that is short.
SEEN, SHORT = 4, 16
#: Characters of text in a batch of small documents.
SLICE = 1 << 19

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = mixed((out ^ p) * _MIX)
    return out


def _long(raw: bytes, words: int) -> np.ndarray:
    """:func:`shingles` of one very long text, whose words are cut part by part."""
    each = [Words.of([part], SPACED).hashes() for part in parts(raw, PART)]
    every = np.concatenate(each)
    n = len(every) - words + 1
    if n < 1:
        return _chained([every[k : k + 1] for k in range(len(every))]) if len(every) else every
    found = [np.unique(_chained([every[a + k : min(a + PART, n) + k] for k in range(words)])) for a in range(0, n, PART)]
    return np.unique(np.concatenate(found))


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct runs of ``words`` words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; of the whole sequence if it is
    shorter."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    every = Words.of([b"" if len(r) > PART else r for r in raw], SPACED)
    each = every.hashes()
    n = len(each) - words + 1
    runs = _chained([each[k : k + n] for k in range(words)]) if n > 0 else each[:0]
    out = []
    for r, a, b in zip(raw, every.first[:-1].tolist(), every.first[1:].tolist()):
        if len(r) > PART:
            out.append(_long(r, words))
        elif b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(_chained([each[k : k + 1] for k in range(a, b)]) if b > a else each[:0])
    return out


@lru_cache(maxsize=4)
def _drawn(k: int, share: float = 0.8) -> np.ndarray:
    """For unions of 0 to 16 ``k`` values: how many of the ``k`` smallest both sets have at least, but for a chance of ``MISSED``, if they share ``share`` of the
    union. Which values are smallest is chance, so the number is hypergeometric."""
    ln = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 16 * k + 1)))))
    out = np.zeros(16 * k + 1, dtype=np.int64)
    for n in range(1, 16 * k + 1):
        both, draw = math.ceil(share * n - 1e-9), min(k, n)
        x = np.arange(max(0, draw - (n - both)), min(draw, both) + 1)
        log = ln[both] - ln[x] - ln[both - x] + ln[n - both] - ln[draw - x] - ln[n - both - draw + x] - ln[n] + ln[draw] + ln[n - draw]
        out[n] = x[np.searchsorted(np.cumsum(np.exp(log)), MISSED, side="right")]
    return out


def _asked(union: np.ndarray, k: int) -> np.ndarray:
    """:func:`_drawn` for unions of any size: beyond the table by the binomial limit, which asks for less."""
    limit = 0
    chance = 0.0
    while (chance := chance + math.comb(k, limit) * 0.8**limit * 0.2 ** (k - limit)) < MISSED:
        limit += 1
    table = _drawn(k)
    return np.where(union < len(table), table[np.minimum(union, len(table) - 1)], limit)


def least_shared(n: int | np.ndarray, k: int = SKETCH) -> np.ndarray:
    """Retained values that a set of ``n`` shares at least with any set of similarity 0.8: their union has up to 1.25 ``n`` values."""
    n = np.asarray(n, dtype=np.int64)
    return np.where(n <= k, np.minimum(-(-4 * n // 5), 3 * k // 4), _asked(-(-5 * n // 4), k))


def union_estimate(a: bytes, b: bytes, k: int = SKETCH) -> float:
    """Similarity as the share of the ``k`` smallest values of both sketches, given by their upper 32 bits, that both have."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)[:k]
    return np.isin(union, np.intersect1d(x, y)).sum() / max(1, len(union))


def union_estimates(a: list[bytes], b: list[bytes], k: int = SKETCH) -> np.ndarray:
    """:func:`union_estimate` of many pairs at once, by sorting both sketches of each pair in one row."""
    none = np.uint32(2**32 - 1)
    out = np.empty(len(a))
    for at in range(0, len(a), 4096):
        rows = np.full((min(4096, len(a) - at), 2 * k), none, dtype=np.uint32)
        for side, some in ((0, a[at : at + 4096]), (k, b[at : at + 4096])):
            sizes = np.asarray([len(x) // 4 for x in some])
            rows[:, side : side + k][np.arange(k) < sizes[:, None]] = np.frombuffer(b"".join(some), "<u4")
        rows.sort(axis=1)
        again = (rows[:, 1:] == rows[:, :-1]) & (rows[:, 1:] != none)
        new = np.concatenate((rows[:, :1] != none, (rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] != none)), axis=1)
        rank = np.cumsum(new, axis=1)
        out[at : at + len(rows)] = (again & (rank[:, 1:] <= k)).sum(axis=1) / np.maximum(1, np.minimum(k, rank[:, -1]))
    return out


def set_key(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest() if len(hashes) else None


def sketched(docs: DataFrame, words: int, k: int = SKETCH) -> DataFrame:
    """doc_id, crc (of the text), n_shingles, set_key (null for the empty set), sketch (bytes)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in slices(batches, SLICE):
            sets = shingles(some, words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in some], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([s[:k].astype("<u8").tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "crc", "n_shingles", "set_key", "sketch"],
            )

    return texts(docs).mapInArrow(lean(sketch), "doc_id long, crc long, n_shingles long, set_key binary, sketch binary")


def postings(classes: DataFrame, k: int = SKETCH) -> DataFrame:
    """(value, rep, own) of the values that list a class, without those that no other class has; ``own`` is the share of the sketch that no other class has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = batch.column("sketch").to_pylist()
            sizes = np.asarray([len(s) // 8 for s in sketches], dtype=np.int64)
            most = sizes - least_shared(batch.column("n_shingles").to_numpy(zero_copy_only=False), k) + SEEN
            values = np.frombuffer(b"".join(sketches), "<i8")
            rep, size, most = (np.repeat(x, sizes) for x in (batch.column("rep").to_numpy(zero_copy_only=False), sizes, most))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(rep), pa.array(size, pa.int32()), pa.array(most, pa.int32())], ["value", "rep", "size", "most"])

    every = classes.mapInArrow(lean(spread), "value long, rep long, size int, most int")
    often = every.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    listed = every.join(often, "value")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("df", "value"))
    alone = F.col("size") - F.count("*").over(Window.partitionBy("rep"))  # values of no other class stand first
    ranked = listed.withColumn("nth", nth).withColumn("alone", alone)
    return ranked.where(F.col("nth") + F.col("alone") <= F.col("most")).select("value", "rep", (F.col("alone") / F.col("size")).alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b): the smallest node that can be reached. Labels take the least of the neighbours' and jump to their
    label's label, so rounds grow with the logarithm of a component's width; each is written down."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "op9-edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = staged(labels, "op9-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = staged(step.join(far, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "op9-labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def estimated(pairs: DataFrame, sketches: DataFrame, k: int = SKETCH) -> DataFrame:
    """``pairs`` (a, b) whose union sketch doesn't rule out the similarity. ``sketches`` has rep, n (size of the full set) and sketch (upper halves)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            est = union_estimates(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), k)
            union = -(-5 * (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) // 9)  # of a pair that is just similar enough
            keep = pa.array(est * np.minimum(union, k) + 1e-6 >= np.minimum(_asked(union, k), 0.8 * union), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    of = lambda end: sketches.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(judge), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with 100 * intersection >= percent * union of the full sets."""
    of = lambda end: sets.select(F.col("rep").alias(end), F.col("hashes").alias(f"s{end}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.where((100 + percent) * F.size(F.array_intersect("sa", "sb")) >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def short_sketches(classes: DataFrame, uri: str) -> DataFrame:
    """(rep, n, sketch) with the upper halves of the sketches of ``classes``, of those that the filter of first ids at ``uri`` lets through."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(passing(uri, batch.column("first_id").to_numpy(zero_copy_only=False)), pa.bool_()))
            upper = [(np.frombuffer(x, "<u8") >> np.uint64(32)).astype("<u4").tobytes() for x in some.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("n_shingles"), pa.array(upper, pa.binary())], ["rep", "n", "sketch"])

    return staged(classes.select("rep", "first_id", "n_shingles", "sketch").mapInArrow(lean(short), "rep long, n long, sketch binary"), "op9-short")


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(rep, hashes) of the full sets of ``classes`` (set_key, rep, first_id), from the texts of their first documents again. A filter of bounded size says which
    texts are worth it."""
    uri = number_filter(classes, "first_id", work_dir(docs.sparkSession, "op9-filter"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passing(uri, batch.column("doc_id").to_numpy(zero_copy_only=False))
            for _, some in slices(iter([batch.filter(pa.array(keep, pa.bool_()))]), SLICE):
                sets = {set_key(h): h for h in shingles(some, words)}
                ends = np.cumsum([0, *map(len, sets.values())]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(sets.values())).view(np.int64)))],
                    ["set_key", "hashes"])

    rows = docs.mapInArrow(lean(whole), "set_key binary, hashes array<long>").join(classes.select("set_key", "rep"), "set_key")
    return staged(rows.groupBy("set_key").agg(F.first("rep").alias("rep"), F.first("hashes").alias("hashes")).drop("set_key"), "op9-sets")


def placed_values(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(value, rep, n, own, reach): the rarest values of the full sets in long lists that leaders haven't brought together, with the reach that a value's place leaves; ``own`` is the number of values
    that none of the others has."""
    named = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = named.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value")
    members = staged(named.join(open_, "value", "left_semi").select("rep").distinct(), "op9-open")

    every = sets.join(members, "rep").select("rep", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    often = every.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = every.join(often, "value")
    by_rep = Window.partitionBy("rep")
    counted = shared.withColumn("own", F.col("n") - F.count("*").over(by_rep)).withColumn("i", F.row_number().over(by_rep.orderBy("df", "value")) - 1 + F.col("own"))
    reach = F.floor((5 * F.col("n") - 9 * F.col("i")) / 4)  # most values that a partner may have, if this is the first value that both have
    placed = counted.withColumn("reach", reach).where(5 * F.col("reach") >= 4 * F.col("n")).select("value", "rep", "n", "own", "reach")
    return staged(placed, "op9-placed")


def split_values(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``placed`` under values that different components have, with label and minor: whether it isn't the label that most have there."""
    named = placed.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = named.groupBy("value", "label").agg(F.count("*").alias("c"))
    main = parts.groupBy("value").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("value", "main")
    return named.join(main, "value").withColumn("minor", F.col("label") != F.col("main"))


def scouted(split: DataFrame) -> DataFrame:
    """Pairs (a, b) of each row that isn't of its value's main component with the ``SEEN`` rows of that component that have the fewest values of their own, which are the ones that most others are
    linked with. They only bring components together before :func:`remaining`, which then leaves no pair of them."""
    nth = F.row_number().over(Window.partitionBy("value").orderBy("own", "rep"))
    lead = split.where("not minor").select("value", "rep", "own").withColumn("nth", nth).where(F.col("nth") <= SEEN).select("value", F.col("rep").alias("lead"))
    met = split.where("minor").select("value", "rep").join(lead, "value")
    return met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``links`` (a, b) too; nodes that aren't there are their own labels."""
    named = links
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(end, F.coalesce(f"l{end}", end)).drop(f"l{end}")
    joined = components(named).select(F.col("node").alias("label"), F.col("label").alias("least"))
    old = labels.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    new = joined.select(F.col("label").alias("node"), F.col("least").alias("label")).join(labels, "node", "left_anti")
    return staged(old.unionByName(new), "op9-labels")


def remaining(split: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, out of :func:`split_values`: every pair of theirs with a similarity of 0.8 or more is among them."""
    # The larger of a pair goes to all bands of sizes that it reaches, the smaller to its own.
    band = lambda n: F.floor(F.log(n) * 50).cast("int")
    less = F.ceil(4 * F.col("n") / 5)
    large = split.withColumn("band", F.explode(F.sequence(band(less), band(F.least("n", "reach")))))
    large = large.select("value", "band", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("reach").alias("ra"), F.col("minor").alias("ma"))
    small = split.where("reach >= n").select("value", band(F.col("n")).alias("band"), F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("reach").alias("rb"),
        F.col("minor").alias("mb"))
    fits = "la <> lb and na >= nb and nb <= ra and na <= rb and (na > nb or a < b or not ma or not mb)"
    at = ["value", "band"]
    minors = small.where("mb")
    met = large.where("ma").join(small, at).where(fits).select("a", "b")
    more = large.where("not ma").join(minors.select(*at).distinct(), at, "left_semi").join(minors, at).where(fits).select("a", "b")
    return met.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def judged(docs: DataFrame, words: int, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """:func:`near_duplicates` with the crc of each row's text and a number of its component, which is null for empty sets."""
    if percent < 80:
        raise ValueError("similarities below 80 percent need longer lists")
    known = staged(sketched(docs, words, k), "op9-sketches")
    classes = known.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "op9-classes")
    lists = staged(postings(classes, k), "op9-postings")
    lists = staged(lists.join(lists.groupBy("value").agg(F.count("*").alias("members")).where("members > 1"), "value"), "op9-lists")

    short, long_ = lists.where(F.col("members") <= SHORT), lists.where(F.col("members") > SHORT)
    met = short.select("value", F.col("rep").alias("a")).join(short.select("value", F.col("rep").alias("b")), "value").where("a < b")
    met = met.groupBy("a", "b").count().where(F.col("count") >= SEEN).select("a", "b")
    lead = long_.groupBy("value").agg(F.min(F.struct("own", "rep")).alias("lead"))
    stars = long_.join(lead, "value").where("rep <> lead.rep").select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
    pairs = staged(met.unionByName(stars).distinct(), "op9-met")

    def ends(*some: DataFrame) -> DataFrame:
        """The classes of the documents in ``some``, without sketches."""
        reps = some[0]
        for more in some[1:]:
            reps = reps.unionByName(more)
        return classes.select("set_key", "rep", "first_id").join(reps.distinct(), "rep", "left_semi")

    both = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    members = long_.select("rep")
    sketches = short_sketches(classes, number_filter(staged(ends(both(pairs), members), "op9-ends"), "first_id", work_dir(docs.sparkSession, "op9-filter")))
    near = staged(estimated(pairs, sketches, k), "op9-candidates")
    sets = full_sets(texts(docs), staged(ends(both(near), members), "op9-listed"), words)
    labels = components(confirmed(near, sets, percent))

    placed = placed_values(long_, labels, sets)
    for met in (scouted, remaining):
        pairs = staged(estimated(met(split_values(placed, labels)), sketches, k), "op9-candidates")
        labels = merged(confirmed(pairs, sets, percent), labels)

    nodes = classes.select("set_key", "first_id", F.col("rep").alias("node")).join(labels, "node", "left").select("set_key", "first_id", F.coalesce("label", "node").alias("label"))
    low = nodes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    out = known.select("doc_id", "crc", "n_shingles", "set_key").join(nodes.join(low, "label").select("set_key", "label", "component_id"), "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), "crc", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``percent``), kept (it is the component's smallest).

    ``docs`` has doc_id and text; more columns don't matter. Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows of one doc_id
    give a row each, and different texts under one doc_id are judged each by itself. ``percent`` must be at least 80, for which list lengths and estimates are laid
    out. Very long texts are cut into words part by part.
    """
    return judged(docs, words, percent, k).drop("crc", "component")


def deduplicated(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """``docs`` with their columns, one row of each group of near duplicates: of the smallest doc_id, where that has several texts of the group the one with the
    least crc, and of rows that repeat it the one with the least hash of all columns. Rows without an id stay, as they can't be compared by it; rows without words
    stay, one for each doc_id."""
    told = judged(docs, words, percent).where("kept").groupBy("doc_id", "component").agg(F.min("crc").alias("__crc")).select(F.col("doc_id").alias("__id"), "__crc")
    keyed = docs.withColumn("__key", F.col("doc_id").cast("long")).withColumn("__of", F.crc32(F.coalesce("text", F.lit(""))))
    same = (F.col("__key") == F.col("__id")) & (F.col("__of") == F.col("__crc"))
    nth = F.row_number().over(Window.partitionBy("__key", "__of").orderBy(F.xxhash64(*docs.columns)))
    kept = keyed.join(told, same, "left_semi").withColumn("__nth", nth).where("__nth = 1")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
