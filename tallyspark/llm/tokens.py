"""Token ids of a public tokenizer, with the work per word done once per worker.

The vocabulary file's splitting rule never lets a token span white space, so a text's ids are those of its blank-separated
pieces in order. A worker keeps the ids of pieces it has met. New pieces go to the tokenizers library in bulk.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Pieces after which the younger of the two generations that a worker remembers becomes the older one, and pieces that go to the tokenizer at once. Results don't depend on
#: either.
REMEMBERED = 100_000
RUN = 20_000
#: Signs, a Latin word, signs: parts that the vocabulary file's rule splits in any case (no apostrophe before the word, which could take its first letters).
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")


def _lowered(texts: pa.Array) -> pa.Array:
    """Lower case where that is the vocabulary file's own: letters up to ÿ. Texts that may name a special token, which is matched as written, stay."""
    stay = pc.match_substring_regex(texts, r"<\||[^\x00-\xff]")
    return pc.if_else(stay, texts, pc.utf8_lower(texts))


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        #: The same model for lower-case Latin words, which need no normalisation and no splitting but at blanks.
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.full.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for token, i in self.full.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.signs: dict[str, bytes] = {"": b""}
        #: Pieces and their ids, as bytes in Arrow's arrays: an entry takes some 40 bytes, where a dictionary of Python's takes 200.
        self.none = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.young = self.old = self.none

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different lower-case Latin words."""
        if not words:
            return {}
        ids = np.asarray(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a model whose words don't all close: ask for each
            return {w: self._bytes(self.full.encode(w, add_special_tokens=False).ids) for w in words}
        raw, stops = ids.tobytes(), (ends * 4).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *stops], stops)}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of different blank-separated pieces."""
        parts: list[tuple[str, str, str, str]] = []
        other: list[str] = []
        out: dict[str, bytes] = {}
        for piece in pieces:
            if piece.isalpha() and piece.isascii():
                parts.append((piece, "", piece.lower(), ""))
            elif "<|" not in piece and (m := _PLAIN.fullmatch(piece)):
                parts.append((piece, m[1], m[2].lower(), m[3]))
            else:
                other.append(piece)
        words = self._plain(list({p[2] for p in parts if p[2]}))
        words[""] = b""
        signs = self.signs
        if len(signs) > REMEMBERED:
            signs = self.signs = {"": b""}
        for piece, before, word, after in parts:
            if before or after:
                for sign in (before, after):
                    if sign not in signs:
                        signs[sign] = self._bytes(self.full.encode(sign, add_special_tokens=False).ids)
                out[piece] = signs[before] + words[word] + signs[after] if word else self._bytes(self.full.encode(piece,
                    add_special_tokens=False).ids) if before and after else signs[before] or signs[after]
            else:
                out[piece] = words[word]
        for piece, got in zip(other, self.full.encode_batch_fast(other, add_special_tokens=False)):
            out[piece] = self._bytes(got.ids)
        return [out[p] for p in pieces]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of different pieces in the younger generation, after those that it lacked have been put there: from the older one, or from the tokenizer."""
        if len(self.young[0]) > REMEMBERED:
            self.old, self.young = self.young, self.none
        (young, young_ids), (old, old_ids) = self.young, self.old
        places = pc.index_in(pieces, value_set=young).fill_null(-1).to_numpy().astype(np.int64)
        lacked = np.flatnonzero(places < 0)
        if len(lacked):
            pieces = pieces.take(pa.array(lacked))
            before = pc.index_in(pieces, value_set=old)
            again, new = before.is_valid(), pieces.filter(before.is_null())
            raw = [pa.array(self._ids(new[k : k + RUN].to_pylist()), pa.large_binary()) for k in range(0, len(new), RUN)]
            self.young = pa.concat_arrays([young, pieces.filter(again), new]), pa.concat_arrays([young_ids, old_ids.take(before.drop_null()), *raw])
            places[lacked[np.argsort(before.is_null().to_numpy(zero_copy_only=False), kind="stable")]] = np.arange(len(young), len(self.young[0]))
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's first place among them, with the end. What the texts share is looked up once, so a few
        megabytes at a time are best. Free memory of the call before goes back first."""
        common.give_back()
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        split = pc.split_pattern(pc.replace_substring(_lowered(texts.cast(pa.large_string())), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy()
        del split
        places = self._places(coded.dictionary)
        each = self.young[1].take(pa.array(places[coded.indices.to_numpy()]))
        _, ends, raw = each.buffers()
        total = np.frombuffer(ends, np.int64, len(each) + 1) // 4
        return np.frombuffer(raw or b"", "<u4", total[-1]), total[bounds - bounds[0]]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after the ids of each text."""
    if end_id is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary."""
    return WordIds(path)


common.REMEMBERED.append(("tokens", word_ids.cache_clear))
