"""Token ids of whole texts with a public tokenizers file.

The library encodes every distinct word once per worker; the ids of a text are those of its words in turn, which is what
the library itself does with this file: normalise, split into words, encode each word. Texts with characters outside
Latin (code point 0x250 and up, as they are or in lower case), control characters or the file's special strings go through the library as a whole.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np

from .common import SLICE_BYTES, PrefixHash, code_points, mix64, text_slices  # noqa: F401

#: Words kept in a worker's table before it starts afresh.
CACHE_WORDS = 500_000
_LATIN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    kinds = np.full(_LATIN, _OTHER, np.uint8)
    for c in range(_LATIN):
        cat = unicodedata.category(chr(c))[0]
        kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(cat, _OTHER)
    kinds[[9, 10, 13, 32]] = _SPACE
    return kinds


def _byte_symbols() -> list[str]:
    """The printable stand-in that byte-level files have for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


#: Code points that the word path handles as the library does: those whose lower case is one Latin code point too.
_SAFE = np.zeros(_LATIN + 1, bool)
_SAFE[[c for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, _LATIN)) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < _LATIN]] = True
_SLOTS = 22


# The parts of a tokenizers file that the word path can stand for; texts of any other file go through the library.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_word(spec: dict) -> bool:
    """Is the file one whose ids are those of its lower-cased words in turn?"""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    parts = pre.get("pretokenizers", [])
    return (
        norm.get("normalizers") == _NORMALIZERS
        and len(parts) == 2
        and parts[0].get("pattern", {}).get("Regex") == _SPLIT
        and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex")
        and all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens", []))
        and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
        and model.get("type") == "BPE"
        and not model.get("dropout")
    )


class WordEncoder:
    """Encodes lists of texts; one per worker and file."""

    _open: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spec = json.loads(self.whole.to_str())
        self.by_word = _by_word(spec)
        self.kinds, self.symbols = _classes(), _byte_symbols()
        self._clear()

    @classmethod
    def open(cls, path: str) -> "WordEncoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = self.n_words = 0
        self.slot_key = np.zeros(1 << _SLOTS, np.uint64)
        self.slot_word = np.zeros(1 << _SLOTS, np.int32)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encode new words and append them to the table; their numbers."""
        split, symbols = self.model.tokenize, self.symbols
        ids = [[t.id for t in split(w if w.isascii() else "".join([symbols[b] for b in w.encode()]))] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        k, total = self.n_words, int(size.sum())
        while k + len(ids) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.at[k : k + len(ids)], self.size[k : k + len(ids)] = self.used + np.cumsum(size) - size, size
        self.used, self.n_words = self.used + total, k + len(ids)
        return np.arange(k, k + len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row offsets)."""
        odd = self._odd(texts)
        if not odd:
            return self._fast(texts)
        slow = {i: np.array(e.ids, np.uint32) for i, e in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True)}
        ids, off = self._fast([t for i, t in enumerate(texts) if i not in slow])
        parts, k = [], 0
        for i in range(len(texts)):
            if i in slow:
                parts.append(slow[i])
            else:
                parts.append(ids[off[k] : off[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _odd(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return list(range(len(texts)))
        codes, off = code_points(texts)
        bad = np.flatnonzero(~_SAFE[np.minimum(codes, _LATIN)])
        rows = set((np.searchsorted(off, bad, side="right") - 1).tolist())
        return sorted(rows | {i for i, t in enumerate(texts) if "<|" in t})

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lowered = [t.lower() for t in texts]
        codes, off = code_points(lowered)
        n = len(codes)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        kind = self.kinds[codes]
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        row_starts = off[:-1][off[:-1] < n]
        begins[row_starts] = True
        self._contractions(codes, kind, begins, off)
        space = kind == _SPACE
        begins &= ~space
        stop = begins | space
        stop[row_starts] = True
        stops = np.flatnonzero(stop)
        at = np.flatnonzero(begins[stops])
        starts, ends = stops[at], np.append(stops, n)[at + 1]
        word = self._words(codes, starts, ends, "".join(lowered))
        size = self.size[word]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.at[word] - total[:-1], size)]
        return ids, total[np.searchsorted(starts, off)]

    def _words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        """The table's number of each word; words not seen before are encoded once."""
        keys = mix64(PrefixHash(codes, small=True).ranges(starts, ends))
        slot = (keys >> np.uint64(64 - _SLOTS)).astype(np.int64)
        word = self.slot_word[slot]
        miss = np.flatnonzero(self.slot_key[slot] != keys)
        if len(miss):
            unique, where, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            if len(self.known) + len(unique) > CACHE_WORDS and self.known:
                self._clear()
                return self._words(codes, starts, ends, text)
            listed = unique.tolist()
            index = np.array([self.known.get(key, -1) for key in listed], np.int64)
            new = np.flatnonzero(index < 0)
            at = miss[where[new]]
            index[new] = self._learn([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.known.update(zip([listed[j] for j in new.tolist()], index[new].tolist()))
            word[miss] = index[inverse]
            slot = (unique >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.slot_key[slot], self.slot_word[slot] = unique, index
        return word

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, begins: np.ndarray, off: np.ndarray) -> None:
        """An apostrophe that stands alone between other kinds takes a following s t m d re ve ll with it."""
        n = len(codes)
        p = np.flatnonzero((codes == 39) & begins)
        p = p[(p + 1 < n) & ~np.isin(p + 1, off)] if len(p) else p
        p = p[(kind[p + 1] == _LETTER) & begins[p + 1]]
        one = codes[p + 1]
        two = np.where((p + 2 < n) & ~np.isin(p + 2, off), codes[np.minimum(p + 2, n - 1)], 0)
        inner = (p + 2 < n) & ~begins[np.minimum(p + 2, n - 1)]
        pair = inner & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        single = np.isin(one, [115, 116, 109, 100])
        for taken, k in ((single, 1), (pair & ~single, 2)):
            q = p[taken]
            begins[q + 1] = False
            q = q[q + 1 + k < n] + 1 + k
            begins[q[kind[q] == _LETTER]] = True
