"""Words of many texts as numbers, by whole-array operations over their bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(25)
_OF_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 2**62, dtype=np.uint64)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)
#: Lower case; 0 ends a word.
LETTERS = np.asarray([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], dtype=np.uint8)


#: The same for words between white space; a zero byte is a letter like others.
SPACED = np.asarray([0 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c or 255 for c in range(256)], dtype=np.uint8)


#: Bytes of a text that are worked on at once.
PART = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(raw: bytes, size: int | None = None) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes that end behind white space, so that no word is cut; a longer word makes a longer part."""
    at, size = 0, size or PART
    while at < len(raw):
        space = _SPACE.search(raw, min(at + size, len(raw)))
        stop = space.end() if space else len(raw)
        yield raw[at:stop]
        at = stop


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([_U(1)], np.cumprod(np.full(n, base, dtype=np.uint64))))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """Words of joined texts: ``begin`` and ``end`` in the bytes, ``text`` they belong to, ``first`` word of each text (with the end)."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], table: np.ndarray = LETTERS) -> Words:
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        sizes = np.asarray([len(t) + 1 for t in texts], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))) if len(texts) else np.zeros(1, np.int64)
        normal = table[raw]
        inside = np.concatenate(([False], normal > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        first = np.searchsorted(begin, offsets)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        n = 1 << max(16, int(len(raw)).bit_length())
        sums = np.concatenate(([_U(0)], np.cumsum(_OF_BYTE[normal] * _powers(_BASE, n)[: len(raw)])))
        return cls(raw, begin, end, text, first, offsets, sums)

    def hashes(self, end: np.ndarray | None = None, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """64-bit hashes of the words, or of their parts up to ``end``."""
        begin = self.begin[which]
        end = self.end[which] if end is None else end
        n = 1 << max(16, int(len(self.raw)).bit_length())
        return mixed((self.sums[end] - self.sums[begin]) * _powers(_BACK, n)[begin] + (end - begin).astype(np.uint64))
