"""Operator 8: benchmark decontamination by a generalised suffix automaton of the normalised test items.

Items are numbered word by word and inserted into one automaton per block of items. A document's words are streamed through it:
state and length say the longest piece of any item that ends at the word. A window is ``window`` consecutive words of an item;
an item of fewer words is one window as a whole.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_batch, fetch, lean, put, slices, staged, texts, work_dir
from .wordhash import PART, Words, parts

WINDOW = 10
#: Item words in one automaton. More items give more automata, which each task goes through one after another.
BLOCK_WORDS = 100_000

#: Upper-case A-Z to lower case; what can't stand in a word to a blank. Bytes from 128 are parts of other letters.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as UTF-8."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.names: list[object] = []
        coded = []
        for name, words in items:
            if words:
                self.names.append(name)
                coded.append([self.vocab.setdefault(w, len(self.vocab)) for w in words])
        for seq in coded:
            last = 0
            for a in seq:
                last = self._extend(last, a)
        #: Items that hold a state's longest window; pieces shorter than a window are of no interest.
        self.owners: list[set[int]] = [set() for _ in self.next]
        #: (words, item) of whole items shorter than a window.
        self.whole: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        for k, seq in enumerate(coded):
            state = 0
            for a in seq:
                state = self.next[state][a]
                s = state
                while s > 0 and self.size[s] >= window and k not in self.owners[s]:
                    self.owners[s].add(k)
                    s = self.link[s]
            if len(seq) < window:
                while self.size[self.link[state]] >= len(seq):
                    state = self.link[state]
                self.whole.setdefault(state, []).append((len(seq), k))
                self.least = min(self.least, len(seq))
        #: The nearest state, itself or on the way to the root, with whole items, and the last one on that way whose pieces are as long as a window.
        self.short, self.top = [0] * len(self.next), list(range(len(self.next)))
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            if self.size[self.link[s]] >= window:
                self.top[s] = self.top[self.link[s]]
            if self.whole:
                self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def _copy(self, p: int, q: int, a: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(a) == q:
            self.next[p][a] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, a: int) -> int:
        q = self.next[last].get(a)
        if q is not None:  # an earlier item goes this way
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, q, a)
        new = len(self.next)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and a not in self.next[p]:
            self.next[p][a] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][a]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, a)
        return new

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers in this automaton; -1 for words that no item has."""
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches [begin, end) of words that windows cover, disjoint and in order, and the items of those windows."""
        return self.matched(self.numbers(words))

    def matched(self, known: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """:meth:`match` of words by their numbers."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known >= 0, [0])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[int] = set()
        nxt, link, size, window, short, whole, top = self.next, self.link, self.size, self.window, self.short, self.whole, self.top

        def hit(begin: int, end: int) -> None:
            while spans and begin <= spans[-1][1]:
                begin = min(begin, spans.pop()[0])
            spans.append((begin, end))

        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < self.least:
                continue
            state = length = 0
            for i, a in enumerate(known[begin:end].tolist(), begin):
                while a not in nxt[state] and state:
                    state = link[state]
                    length = size[state]
                if a in nxt[state]:
                    state = nxt[state][a]
                    length += 1
                if length >= window:
                    hit(i + 1 - window, i + 1)
                    states.add(top[state])
                s = short[state]
                while s:
                    for t, k in whole.get(s, ()):
                        if t <= length:
                            hit(i + 1 - t, i + 1)
                            found.add(k)
                    s = short[link[s]]
        for s in states:
            found |= self.owners[s]
        return spans, found


#: Automata that a task keeps; of more, each is loaded once for ``MANY`` characters of text.
KEPT, FEW, MANY = 3, 1 << 21, 1 << 24


@lru_cache(maxsize=KEPT)
def _loaded(uri: str) -> Automaton:
    return pickle.loads(fetch(uri))


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Paths of automata over all ``items``, each of about ``block_words`` words, built where the items are. Items without an id are left out; those without
    words have no window."""
    folder = work_dir(items.sparkSession, "op8-automata")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.sam"
            put(path, pickle.dumps(Automaton(held, window)))
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((i, words := words_of(text)))
                size += len(words)
                if size >= block_words:
                    yield close()
                    held, size = [], 0
        if size:
            yield close()

    few = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null").distinct()
    chars = few.agg(F.sum(F.length("t"))).first()[0] or 0
    few = few.coalesce(1) if chars <= 8 * block_words else few.repartition(-(-chars // (8 * block_words)))
    return sorted(r["path"] for r in staged(few.mapInArrow(lean(make), "path string"), "op8-paths").collect())


def _scans(paths: list[str], some: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, covered stretches, items) of each text. Each automaton is loaded once for all of them; a long text is cut into words part by part."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in some]
    short = [words_of(r) if len(r) <= PART and len(paths) <= KEPT else None for r in raw]
    count = [len(w) if w is not None else sum(len(words_of(p)) for p in parts(r)) for w, r in zip(short, raw)]
    spans: list[list[tuple[int, int]]] = [[] for _ in some]
    items: list[set[str]] = [set() for _ in some]
    for path in paths:
        automaton = _loaded(path)
        for k, words in enumerate(short):
            known = automaton.numbers(words) if words is not None else np.concatenate([automaton.numbers(words_of(p)) for p in (b"", *parts(raw[k]))])
            more, found = automaton.matched(known)
            spans[k] += more
            items[k].update(automaton.names[j] for j in found)
    return [(n, _joined(s) if len(paths) > 1 else s, sorted(i)) for n, s, i in zip(count, spans, items)]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (word positions [begin, end) that windows cover) and items of each document.

    Each row of ``docs`` gives a row, repeated or not; null and empty texts have no words and hit nothing. An empty table of items leaves all documents clean.
    """
    paths = build(items, window=window, block_words=block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in slices(batches, FEW if len(paths) <= KEPT else MANY):
            got = _scans(paths, some)
            hit = [sum(e - b for b, e in g[1]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(g[2]) for g in got], pa.int64()),
                    pa.array([hashlib.sha256(",".join(g[2]).encode()).hexdigest() for g in got]),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                    pa.array([[{"begin": b, "end": e} for b, e in g[1]] for g in got], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )

    return texts(docs).mapInArrow(lean(scan),
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<begin:long,end:long>>, items array<string>")


def cut(text: str, spans: list[tuple[int, int]], longest: int, coverage: float) -> str | None:
    """``text`` without the stretches of at least ``longest`` words; None if covered words exceed the share ``coverage``."""
    raw = text.encode("utf-8", "surrogatepass")
    begins, ends, at = [], [], 0
    for part in parts(raw):
        words = Words.of([part])
        begins.append(words.begin + at)
        ends.append(words.end + at)
        at += len(part)
    begins, ends = np.concatenate(begins or [np.zeros(0, int)]), np.concatenate(ends or [np.zeros(0, int)])
    if len(begins) and sum(e - b for b, e in spans) > coverage * len(begins):
        return None
    out, at = [], 0
    for b, e in spans:
        if e - b >= longest:
            out.append(raw[at : begins[b]])
            at = int(ends[e - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 1, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with their columns, text without covered stretches of ``longest`` words or more; documents of which more than ``coverage`` is covered go.
    Clean rows stay as they are, null texts too."""
    paths = build(items, window=window, block_words=block_words)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, at, FEW if len(paths) <= KEPT else MANY):
                texts_ = part.column(at).to_pylist()
                kept, out = [], []
                for k, (text, (_, spans, _)) in enumerate(zip(texts_, _scans(paths, texts_))):
                    if spans and (text := cut(text, spans, longest, coverage)) is None:
                        continue
                    kept.append(k)
                    out.append(text)
                rest = pa.Table.from_batches([part]).take(pa.array(kept, pa.int64())).set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))
                yield from rest.combine_chunks().to_batches()

    return docs.mapInArrow(lean(clean), docs.schema)
