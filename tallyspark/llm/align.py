"""Operator 11: align the tokens of two tokenizers over the same bytes, and count which ids meet across the corpus.

Both tokenizers cut at every character that isn't white space and is followed by a blank or a line end, and neither joins anything
across such a place. So a text is the row of its chunks (blanks or line ends, and what follows up to the next such place), and a chunk's
alignment is the same wherever it stands. A worker aligns each chunk that is new to it once, many at a time: the union of both arrays of
token ends gives elementary intervals, binary search names the token of either side that owns an interval, each interval is one
overlapping pair, and an interval that ends where both its tokens do closes a group.

Texts are encoded once. What a document has of its own, and its linked pairs of ids with how often it links them, are written to the
shared folder. Pairs are then counted by document, each partition adding up its own before anything is shuffled, put in order and written
as shards, each with the counts of its pairs and of the best pair of their first id; documents look their pairs up there, a shard at a time.

Cases: null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens: zeros, no group. Rows without an id
can't be named in a result and are left out, of the counts too. Rows that share a doc_id are documents of their own. Very long texts are
worked on in parts that end between chunks. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import fetch, lean, partitions, put, staged, text_arrays, texts, work_dir

#: Characters of a text that are split at once, chunks that are encoded as one text, chunks that a worker remembers, pairs in a shard, shards that a worker
#: holds, documents whose pairs are looked up at once. Results don't depend on them.
PART, TOGETHER, REMEMBERED, SHARD, HELD, ROWS = 1 << 20, 400, 500_000, 1 << 17, 8, 1000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: A pair is one number: the first id above these bits.
BITS = 20


def pieces(text: str) -> Iterator[list[str]]:
    """Chunks of a text, a part of about ``PART`` characters at a time."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > PART and (cut := _CUT.search(text, at + PART)):
            stop = cut.start()
        yield _CUT.split(text[at:stop])
        at = stop


def byte_values() -> dict[str, int]:
    """What the characters of a byte-level vocabulary stand for: printable ones for themselves, the others, in order, for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        value, vocabulary = byte_values(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.asarray([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        #: Ids as text, with the sign behind them inside a group and at the end of its side; their digits.
        said = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.asarray([len(x) for x in said], dtype=np.int64)
        self.a_said, self.b_said = (np.asarray([[x + b"," for x in said], [x + end for x in said]], dtype=object) for end in (b"|", b";"))
        if any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            raise ValueError("the second vocabulary joins what stands before a blank with what follows it")

    def each(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks in both vocabularies. The second tokenizer puts a blank before its text: one that the chunk has, or one that is taken off again."""
        ours = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        theirs = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return ours, [[self.blank] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, theirs)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the first tokenizer, how many of each chunk, the same of the second, whether a chunk is given back by both). Chunks that end in no white space are
        encoded some hundred at a time, as one text that both tokenizers cut between them; a text that isn't given back is taken chunk by chunk."""
        n = len(chunks)
        out: list[list] = [[], []]
        counts, whole = np.zeros((2, n), np.int64), np.zeros(n, bool)
        sizes = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy().astype(np.int64)
        shut = np.asarray([not c[-1].isspace() for c in chunks], bool)
        runs = [range(n)[k : k + TOGETHER] for k in range(0, n, TOGETHER)] if shut.all() else [[k] for k in range(n)]
        texts = ["".join(chunks[k] for k in run) for run in runs]
        for run, text, *ids in zip(runs, texts, *self.each(texts)):
            if self._gives(text, *ids):
                at = np.asarray(run)
                ends = np.cumsum(sizes[at])
                for side, (size, got) in enumerate(zip((self.a_size, self.b_size), ids)):
                    got = np.asarray(got, dtype=np.int64)
                    counts[side, at] = np.diff(np.searchsorted(np.cumsum(size[got]), ends) + 1, prepend=0)
                    out[side].append(got)
                whole[at] = True
            elif len(run) > 1:
                for k, *own in zip(run, *self.each([chunks[k] for k in run])):
                    if self._gives(chunks[k], *own):
                        whole[k] = True
                        for side, got in enumerate(own):
                            counts[side, k] = len(got)
                            out[side].append(np.asarray(got, dtype=np.int64))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return a, counts[0], b, counts[1], whole

    def _gives(self, text: str, ours: list[int], theirs: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in ours]) == raw == b"".join([self.b_bytes[i] for i in theirs])


@dataclass
class Alignment:
    """Of some chunks: whether each is given back by both tokenizers, its tokens, groups and links, the groups as text, and the linked pairs of all, one after
    another. ``products``: all pairs of ids that share a group instead of those that overlap."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: list[bytes]
    pairs: np.ndarray


def align(pair: Pair, chunks: list[str], products: bool = False) -> Alignment:
    a, n_a, b, n_b, whole = pair.encode(chunks)
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    ends = np.union1d(end_a, end_b)  # elementary intervals, by their ends
    of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    closes = (end_a[of_a] == ends) & (end_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
    last_a, last_b = of_a[closes] + 1, of_b[closes] + 1
    chunk_a = np.cumsum(n_a)
    groups = np.searchsorted(last_a, chunk_a, "right")  # groups up to the end of each chunk
    n_groups = np.diff(groups, prepend=0)
    # a group's ids of the first side, then those of the second, each with the sign that follows it
    flat, length = np.empty(len(a) + len(b), object), np.zeros(len(a) + len(b), np.int64)
    for ids, last, before, names in ((a, last_a, np.concatenate(([0], last_b[:-1])) if len(last_b) else last_b, pair.a_said), (b, last_b, last_a, pair.b_said)):
        if len(ids):
            group = np.searchsorted(last, np.arange(len(ids)), "right")
            at = np.arange(len(ids)) + before[group]
            closing = np.zeros(len(ids), np.int64)
            closing[last - 1] = 1
            flat[at] = names[closing, ids]
            length[at] = pair.digits[ids] + 1
    blob = b"".join(flat.tolist())
    total = np.concatenate(([0], np.cumsum(length)))
    stops = total[chunk_a + np.cumsum(n_b)].tolist()
    text = [blob[p : q - 1] if q > p else b"" for p, q in zip([0, *stops], stops)]
    if products:
        first_a, first_b = last_a - np.diff(last_a, prepend=0), last_b - np.diff(last_b, prepend=0)
        each = (last_a - first_a) * (last_b - first_b)
        group = np.repeat(np.arange(len(each)), each)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        wide = (last_b - first_b)[group]
        of_a, of_b = first_a[group] + nth // wide, first_b[group] + nth % wide
    links = (a[of_a] << BITS) | b[of_b]
    n_links = np.diff(np.searchsorted(of_a, chunk_a), prepend=0)
    return Alignment(whole, n_a, n_b, n_groups, n_links, text, links)


class Chunks:
    """Alignments of the chunks that a worker has met, by number. ``pairs`` numbers the pairs of ids in them."""

    def __init__(self, pair: Pair, products: bool):
        self.pair, self.products = pair, products
        self.number: dict[str, int] = {}
        self.pair_number: dict[int, int] = {}
        self.pairs = np.zeros(0, np.int64)
        self.text: list[bytes] = []
        self.whole = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of either side, groups, links
        self.links = np.zeros(0, np.int64)  # pair numbers, chunk after chunk
        self.first = np.zeros(1, np.int64)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        known = self.number
        new = [c for c in set(chunks) if c not in known]
        for k in range(0, len(new), 20_000):
            self._add(new[k : k + 20_000])
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def _add(self, new: list[str]) -> None:
        got = align(self.pair, new, self.products)
        self.number.update(zip(new, range(len(self.text), len(self.text) + len(new))))
        codes, at = np.unique(got.pairs, return_inverse=True)
        fresh = [p for p in codes.tolist() if p not in self.pair_number]
        self.pair_number.update(zip(fresh, range(len(self.pairs), len(self.pairs) + len(fresh))))
        self.pairs = np.concatenate((self.pairs, np.asarray(fresh, dtype=np.int64)))
        links = np.fromiter(map(self.pair_number.__getitem__, codes.tolist()), np.int64, len(codes))[at]
        self.links = np.concatenate((self.links, links))
        self.text.extend(got.text)
        self.whole = np.concatenate((self.whole, got.whole))
        self.sizes = np.concatenate((self.sizes, np.stack((got.n_a, got.n_b, got.n_groups, got.n_links), axis=1)))
        self.first = np.concatenate(([0], np.cumsum(self.sizes[:, 3])))

    def linked(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of some chunks, and how often each is linked there."""
        each = self.sizes[numbers, 3]
        before = np.cumsum(each) - each
        found, times = np.unique(self.links[np.repeat(self.first[numbers] - before, each) + np.arange(int(each.sum()))], return_counts=True)
        return self.pairs[found], times


@lru_cache(maxsize=1)
def _pair(first: str, second: str) -> Pair:
    return Pair(first, second)


@lru_cache(maxsize=HELD)
def _shard(uri: str) -> np.ndarray:
    return np.frombuffer(fetch(uri), "<i8").reshape(3, -1)


common.REMEMBERED.extend([("align", _pair.cache_clear), ("align", _shard.cache_clear)])


def looked_up(shards: Sequence[tuple[int, str]], pairs: np.ndarray) -> np.ndarray:
    """(count, whether it is the best of the first id) of pairs that all are in the shards, a shard at a time."""
    out = np.zeros((len(pairs), 2), np.int64)
    of = np.searchsorted(np.asarray([f for f, _ in shards], dtype=np.int64), pairs, "right") - 1
    for k in np.unique(of).tolist():
        at = np.flatnonzero(of == k)
        code, count, best = _shard(shards[k][1])
        place = np.searchsorted(code, pairs[at])
        out[at, 0], out[at, 1] = count[place], best[place]
    return out


@lru_cache(maxsize=1)
def _known(first: str, second: str, products: bool) -> list[Chunks]:
    """What a worker remembers, for the task after this one too."""
    return [Chunks(_pair(first, second), products)]


common.REMEMBERED.append(("align", _known.cache_clear))


def numbered(chunks: Chunks, some: pa.Array) -> list[np.ndarray]:
    """Chunk numbers of each text. Texts are split at blanks, line ends with a blank put before them, by whole-array operations; those with other white space
    before a blank or a line end are split by the rule itself."""
    lists = pc.split_pattern(pc.replace_substring(some.cast(pa.large_string()), "\n", " \n"), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    numbers = chunks.numbers([w if w[:1] == "\n" else " " + w for w in words])[codes]
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    wide = np.asarray([not w or w[-1].isspace() for w in words], bool)[codes]
    wide[bounds[1:] - 1] = False  # at a text's end
    odd = np.add.reduceat(wide.astype(np.int64), bounds[:-1]) > 0
    out = [numbers[p:q] for p, q in zip(bounds.tolist(), bounds[1:].tolist())]
    for k in np.flatnonzero(odd).tolist():
        out[k] = chunks.numbers(_CUT.split(" " + some[k].as_py()))
    return out


def _documents(batches: Iterator[pa.RecordBatch], known: list[Chunks]) -> Iterator[tuple[Chunks, list[tuple[int, np.ndarray, bool]]]]:
    """Runs of parts of texts, some megabytes at a time: the chunks known so far, and each part's document, chunk numbers and whether the document ends with it."""
    for ids, some in text_arrays(batches):
        size = pc.binary_length(some).to_numpy(zero_copy_only=False)
        short = np.flatnonzero((size > 0) & (size <= 4 * PART))
        run = [(name, np.zeros(0, np.int64), True) for name in ids.take(pa.array(np.flatnonzero(size == 0))).to_pylist()]
        if len(short):
            run += [(name, x, True) for name, x in zip(ids.take(pa.array(short)).to_pylist(), numbered(known[0], some.take(pa.array(short))))]
        yield known[0], run
        for k in np.flatnonzero(size > 4 * PART).tolist():
            name, rows = ids[k].as_py(), pieces(" " + some[k].as_py())
            part = next(rows)
            while part is not None:
                after = next(rows, None)
                yield known[0], [(name, known[0].numbers(part), after is None)]
                part = after
                _forget(known)
        _forget(known)


def _forget(known: list[Chunks]) -> None:
    """With too many chunks to remember, the next run starts anew."""
    if len(known[0].text) > REMEMBERED:
        known[0] = Chunks(known[0].pair, known[0].products)


def linked_documents(docs: DataFrame, first: str, second: str, products: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of each document, its different linked pairs, and how often it links each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, whole, digest, parts_of, held = np.zeros(4, np.int64), True, hashlib.sha256(), 0, []
        for chunks, parts in _documents(batches, _known(first, second, products)):
            names, rows, digests, pairs, times = [], [], [], [], []
            for name, numbers, last in parts:
                if len(numbers):
                    whole = whole and bool(chunks.whole[numbers].all())
                    sizes = sizes + chunks.sizes[numbers].sum(axis=0)
                    digest.update(b";" * bool(parts_of) + b";".join([chunks.text[k] for k in numbers.tolist()]))
                    parts_of += 1
                    held.append(chunks.linked(numbers))
                if len(held) > 1:
                    held = [_summed(held)]
                if last:
                    good = whole and bool(held)
                    names.append(name)
                    rows.append(sizes if good else sizes * 0)
                    digests.append(digest.hexdigest() if good else "")
                    pairs.append(held[0][0] if good else np.zeros(0, np.int64))
                    times.append(held[0][1] if good else np.zeros(0, np.int64))
                    sizes, whole, digest, parts_of, held = np.zeros(4, np.int64), True, hashlib.sha256(), 0, []
            for k in range(0, len(names), ROWS):
                some = slice(k, k + ROWS)
                table = np.asarray(rows[some], dtype=np.int64)
                ends = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs[some]]))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x[some]))) for x in (pairs, times)]
                cols = [pa.array(names[some], pa.int64()), *(pa.array(table[:, c].copy()) for c in range(4)), pa.array(digests[some], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return texts(docs).mapInArrow(lean(run, "align"), kinds)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)


def write_shards(counts: DataFrame, folder: str, size: int = SHARD) -> list[tuple[int, str]]:
    """Counts in order of pairs, with 1 for those that none of the same first id exceeds, in files of about ``size`` pairs in ``folder``: the first pair and name of
    each. All pairs of one first id, at most one for each second id, are in one file. The driver holds a name for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def shard(table: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(table[:, 0] >> BITS, prepend=-1))
            most = np.repeat(np.maximum.reduceat(table[:, 1], starts), np.diff(starts, append=len(table)))
            put(uri := f"{folder}/shard-{task:06d}-{k:05d}", np.stack((table[:, 0], table[:, 1], table[:, 1] == most)).astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([int(table[0, 0])]), pa.array([uri])], ["first", "uri"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n")], axis=1))
            if sum(map(len, held)) >= size:
                table = np.concatenate(held)
                cut = int(np.searchsorted(table[:, 0] >> BITS, table[-1, 0] >> BITS))  # the last first id may go on
                if cut:
                    yield shard(table[:cut])
                    table, k = table[cut:], k + 1
                held = [table]
        if held and len(table := np.concatenate(held)):
            yield shard(table)

    rows = counts.withColumn("a", F.shiftright("pair", BITS)).repartitionByRange(partitions(counts.sparkSession), "a").sortWithinPartitions("pair")
    return sorted((r["first"], r["uri"]) for r in rows.select("pair", "n").mapInArrow(lean(write, "align"), "first long, uri string").collect())


def aligned(docs: DataFrame, first: str, second: str, products: bool = False) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their first id), count_sum (of all links), groups_sha256 (of the
    groups as ``a1,a2|b1;a3|b2,b3``). A pair's count is the number of documents that link it. ``first``: a byte-level vocabulary of the tokenizers library, which gets a
    blank before the text; ``second``: a sentencepiece model that puts one there. With ``products``, all pairs of ids that share a group are links, not only those that overlap."""
    spark = docs.sparkSession
    rows = staged(linked_documents(docs, first, second, products), "op11-documents")
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    shards = write_shards(counts, work_dir(spark, "op11-shards"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                pairs, times = batch.column("pairs"), batch.column("times")
                bounds = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
                codes, at = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
                found = looked_up(shards, codes)[at] * times.flatten().to_numpy()[:, None]
                sums = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(found, axis=0)))
                told = sums[bounds[1:]] - sums[bounds[:-1]]
                own = [batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(told[:, 1].copy()), pa.array(told[:, 0].copy()), batch.column("groups_sha256")],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(lean(judge, "align"), kinds)
