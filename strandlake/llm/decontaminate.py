"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Every document is cut into windows of each item's length in words, one at every word. A window that shares no shingle with
any item of that length has similarity 0 and is passed over. The others get a 256-bit SimHash. Fingerprints are cut into 12
blocks; if two differ in at most 47 bits, some block differs in at most 3, so hash tables by block find every item within
the radius: a table holds what is within 2 bits of an item's block, and a window looks up what is within 1 bit of its own.
Fingerprints of unrelated texts agree in some block less than once in 100 times. Candidates within the radius are
verified by the weighted Jaccard similarity of their shingles (weights are the times a shingle occurs).

The radius is a choice: at a similarity of exactly 0.8 fingerprints differ in 39 bits on average, with a deviation of 6, so
`recall_at` gives 0.93 there, and 0.99 or more from 0.85 on.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _PLACE, U64, mix64, pick_id_text, small_batches, text_slices, utf8_bytes, word_hashes, word_spans

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 12, 47
#: Differing bits of a block that tables and lookups cover; together RADIUS // BLOCKS.
_STORED, _PROBED = 2, 1
#: Items, and bytes of their texts, that travel to the executors at once; more items are searched in further passes over the documents.
MAX_ITEMS, MAX_ITEM_BYTES = 5_000, 32 << 20
_FILTER = 20
#: Windows looked up at once, and words whose votes are summed at once (more for longer items).
_WINDOWS, _WORDS = 1_024, 1 << 14


def _breaks() -> np.ndarray:
    """Bytes between words: all ASCII but letters and digits."""
    t = np.zeros(256, bool)
    t[:128] = [not chr(c).isalnum() for c in range(128)]
    return t


BREAKS = _breaks()
#: Beyond ASCII, words are letters, digits and marks.
_OTHER_BREAKS = r"[^\p{L}\p{N}\p{M}\x00-\x7F]+"
_LOW, _SIZE = [BITS * b // BLOCKS for b in range(BLOCKS)], [BITS * (b + 1) // BLOCKS - BITS * b // BLOCKS for b in range(BLOCKS)]
_SALTS = mix64(np.arange(1, BITS // 64 + 1, dtype=U64))


def recall_at(similarity: float, radius: int = RADIUS, bits: int = BITS) -> float:
    """Share of pairs of this weighted Jaccard similarity within the radius: bits differ independently with the angle between the shingle vectors."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets per row) of lower-cased texts."""
    import pyarrow.compute as pc

    raw, off = utf8_bytes(pc.replace_substring_regex(pc.utf8_lower(col), _OTHER_BREAKS, " "))
    starts, ends, rows = word_spans(raw, off, BREAKS)
    return word_hashes(raw, starts, ends), np.searchsorted(rows, np.arange(len(off)))


def shingles_at(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on, whatever row they are in (shorter at the very end)."""
    out = np.zeros(len(words), U64)
    for k in range(size):
        out[: len(words) - k] += words[k:] * _PLACE[k] + U64(k + 1)
    return mix64(out)


def simhash(features: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """rows x BITS booleans: fingerprints of features[start:start + count] of each row; starts and ends ascend.

    Votes are summed once along the features that some row holds; a row's are a difference of two sums.
    """
    ends = starts + counts
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    run = np.cumsum(new) - 1
    first = starts[new]
    size = np.append(ends[np.flatnonzero(new)[1:] - 1], ends[-1:]) - first
    before = np.cumsum(size) - size
    used = features[np.arange(size.sum()) + np.repeat(first - before, size)]
    at = (before - first)[run] + starts
    out = []
    for salt in _SALTS:
        sums = np.zeros((len(used) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(mix64(used ^ salt).view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32, out=sums[1:])
        out.append(2 * (sums[at + counts] - sums[at]) > counts[:, None])
    return np.concatenate(out, 1)


def _flips(size: int, most: int) -> np.ndarray:
    """Masks of at most `most` set bits among `size`."""
    from itertools import combinations

    return np.array([sum(1 << k for k in c) for n in range(most + 1) for c in combinations(range(size), n)], np.uint32)


_STORE, _PROBE = {n: _flips(n, _STORED) for n in set(_SIZE)}, {n: _flips(n, _PROBED) for n in set(_SIZE)}


class BlockIndex:
    """Multi-index over fingerprints: all rows that share a block, up to _STORED + _PROBED differing bits, with a query."""

    def __init__(self, prints: np.ndarray):
        self.tables = []
        for value, n in zip(self._values(prints), _SIZE, strict=True):
            keys = (value[:, None] ^ _STORE[n]).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], np.repeat(np.arange(len(prints), dtype=np.int32), len(_STORE[n]))[order]))

    @staticmethod
    def _values(prints: np.ndarray) -> list[np.ndarray]:
        return [prints[:, a : a + n] @ (1 << np.arange(n, dtype=np.uint32)) for a, n in zip(_LOW, _SIZE, strict=True)]

    def candidates(self, prints: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs, each once."""
        out = []
        for value, n, (keys, rows) in zip(self._values(prints), _SIZE, self.tables, strict=True):
            probe = (value.astype(np.uint32)[:, None] ^ _PROBE[n]).ravel()
            at = np.searchsorted(keys, probe)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == probe)
            size = np.searchsorted(keys, probe[hit], side="right") - at[hit]
            found = rows[np.arange(size.sum()) + np.repeat(at[hit] - (np.cumsum(size) - size), size)]
            out.append(np.repeat(hit // len(_PROBE[n]), size) * n_rows + found)
        pairs = np.unique(np.concatenate(out))
        return pairs // n_rows, pairs % n_rows


class ItemIndex:
    """Items by length in words: fingerprints, block tables and shingle multisets."""

    def __init__(self, ids: list, texts: list[str], threshold: float, radius: int):
        if radius // BLOCKS > _STORED + _PROBED:
            raise ValueError(f"radius must be below {BLOCKS * (_STORED + _PROBED + 1)}")
        self.threshold, self.radius = threshold, radius
        words, off = words_of(pa.array(texts, pa.string()))
        self.groups: dict[int, dict] = {}
        for n in sorted({int(x) for x in np.diff(off)} - {0}):
            own = [i for i in range(len(ids)) if off[i + 1] - off[i] == n]
            size = min(SHINGLE, n)
            grams = np.stack([shingles_at(words[off[i] : off[i + 1]], size)[: n - size + 1] for i in own])
            width = grams.shape[1]
            rows, step = np.arange(len(own)), max(_WORDS // width, 1)
            prints = np.concatenate([simhash(grams.ravel(), r * width, np.full(len(r), width)) for r in (rows[x : x + step] for x in range(0, len(own), step))])
            every = np.unique(grams)
            # times[i, j]: how often item i has the shingle every[j], for the shingles that it has.
            sets = [np.unique(np.searchsorted(every, g), return_counts=True) for g in grams]
            self.groups[n] = {"size": size, "ids": [ids[i] for i in own], "prints": prints, "all": every, "sets": sets}
        self.masks = {}
        for size in {g["size"] for g in self.groups.values()}:
            mask = np.zeros(1 << _FILTER, bool)
            for g in self.groups.values():
                if g["size"] == size:
                    mask[(g["all"] >> U64(64 - _FILTER)).astype(np.int64)] = True
            self.masks[size] = mask

    def search(self, col: pa.Array) -> list[tuple[int, object, float, int, int]]:
        """(row, item id, similarity, first word, words) of the best window of each document and item that match."""
        words, off = words_of(col)
        found: dict[tuple[int, int, int], tuple] = {}
        for size, mask in self.masks.items():
            grams = shingles_at(words, size)
            maybe = np.flatnonzero(mask[(grams >> U64(64 - _FILTER)).astype(np.int64)]) if len(words) else np.zeros(0, np.int64)
            row = np.searchsorted(off, maybe, side="right") - 1
            inside = maybe + size <= off[row + 1]
            maybe, row = maybe[inside], row[inside]
            value = grams[maybe]
            for n, g in self.groups.items():
                if g["size"] == size and len(maybe):
                    at = np.minimum(np.searchsorted(g["all"], value), len(g["all"]) - 1)
                    hit = g["all"][at] == value
                    if hit.any():
                        self._group(n, g, grams, maybe[hit], row[hit], off, found)
        return [(r, self.groups[n]["ids"][k], *best) for (r, n, k), best in sorted(found.items())]

    def _group(self, n: int, g: dict, grams: np.ndarray, hits: np.ndarray, rows: np.ndarray, off: np.ndarray, found: dict) -> None:
        size = g["size"]
        span = n - size + 1
        # All windows of n words that hold a hit; documents shorter than n are one window.
        lo = np.maximum(hits - span + 1, off[rows])
        hi = np.maximum(np.minimum(hits, off[rows + 1] - n), lo)
        # Ranges run upwards within a row: each begins after the one before it.
        reach = np.concatenate(([-1], np.maximum.accumulate(hi)[:-1]))
        lo = np.maximum(lo, reach + 1)
        length = np.maximum(hi - lo + 1, 0)
        starts = np.arange(length.sum()) + np.repeat(lo - (np.cumsum(length) - length), length)
        own = np.repeat(rows, length)
        if "index" not in g:
            g["index"] = BlockIndex(g["prints"])
        counts = np.minimum(n, off[own + 1] - starts) - size + 1
        ends = starts + counts
        # Windows are taken together by the words that they add.
        added = np.cumsum(ends - np.maximum(starts, np.append(0, ends[:-1]))) // max(_WORDS, span)
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(added)) + 1):
            prints = simhash(grams, starts[part], counts[part])
            for x in range(0, len(part), _WINDOWS):
                self._verify(n, g, grams, off, own, starts, counts, part[x : x + _WINDOWS], prints[x : x + _WINDOWS], found)

    def _verify(self, n: int, g: dict, grams: np.ndarray, off: np.ndarray, own: np.ndarray, starts: np.ndarray, counts: np.ndarray, part: np.ndarray, prints: np.ndarray, found: dict) -> None:
        w, k = g["index"].candidates(prints, len(g["ids"]))
        near = (prints[w] != g["prints"][k]).sum(1) <= self.radius
        w, k = part[w[near]], k[near]
        sims = self._similarity(g, grams, starts[w], counts[w], k)
        same = sims >= self.threshold
        for i, item, sim in zip(w[same].tolist(), k[same].tolist(), sims[same].tolist(), strict=True):
            row = int(own[i])
            if sim > found.get((row, n, item), (0.0,))[0]:
                found[row, n, item] = (sim, int(starts[i] - off[row]), int(counts[i] + g["size"] - 1))

    @staticmethod
    def _similarity(g: dict, grams: np.ndarray, starts: np.ndarray, counts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of each window and its item.

        What a window and its item share is a sum of the lesser counts. The item has a shingle t times: its occurrence at a
        place counts in a window if the t-th occurrence before that place is outside, so it counts in a range of windows,
        and windows side by side are counted in one pass over their words.
        """
        out = np.zeros(len(items))
        order = np.lexsort((starts, counts, items))
        s, c, k = starts[order], counts[order], items[order]
        new = np.flatnonzero((np.diff(k) != 0) | (np.diff(c) != 0) | (np.diff(s) > _WINDOWS)) + 1
        for a, b in zip(np.append(0, new).tolist(), np.append(new, len(s)).tolist(), strict=True):
            if a == b:
                continue
            low, width = int(s[a]), int(c[a])
            text = grams[low : int(s[b - 1]) + width]
            shingles, times = g["sets"][k[a]]
            at = np.minimum(np.searchsorted(g["all"], text), len(g["all"]) - 1)
            place = np.minimum(np.searchsorted(shingles, at), len(shingles) - 1)
            p = np.flatnonzero((g["all"][at] == text) & (shingles[place] == at))
            # Places by shingle, and of each the place as many occurrences before it as the item has.
            p = p[np.argsort(place[p], kind="stable")]
            which = place[p]
            earlier = np.arange(len(p)) - times[which]
            known = (earlier >= 0) & (which[np.maximum(earlier, 0)] == which)
            first = np.maximum(np.where(known, p[np.maximum(earlier, 0)], -1), p - width) + 1
            n = int(s[b - 1]) - low + 1
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.clip(first, 0, n), 1)
            np.add.at(edge, np.minimum(p + 1, n), -1)
            both = np.cumsum(edge)[s[a:b] - low]
            out[order[a:b]] = both / (width + times.sum() - both)
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS):
    """Indexes of about MAX_ITEMS items and MAX_ITEM_BYTES each at most, dealt by a hash; null texts match nothing, repeated items are one."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    many, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = -(-max(many * MAX_ITEM_BYTES, size * MAX_ITEMS) // (MAX_ITEMS * MAX_ITEM_BYTES))
    for b in range(n_blocks):
        part = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("text", "id"), F.lit(n_blocks)) == b)
        got = part.collect()
        yield ItemIndex([r.id for r in got], [r.text for r in got], threshold, radius)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every document and item that match.

    Words are lower-case runs of Unicode letters, digits and marks. Items without words match nothing, items under five
    words have one shingle; null or empty texts match nothing, nor does an empty table; repeated rows give repeated matches,
    items repeated under one id are one item; ties take the first window; texts are whole however long; other columns are
    ignored.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    base, out = pick_id_text(docs, id_col, text_col), None
    for index in item_blocks(items, item_id_col, item_text_col, threshold, radius):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for cut in text_slices(batch):
                    got = shared.value.search(cut.column("text"))
                    ids = cut.column("doc_id").to_pylist()
                    cols = list(zip(*[(ids[r], *rest) for r, *rest in got], strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, in which no window matches an item (as find_contamination() has it)."""
    small_batches(docs.sparkSession)
    for index in item_blocks(items, item_id_col, item_text_col, threshold, radius):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for cut in text_slices(batch, text_col):
                    keep = np.ones(cut.num_rows, bool)
                    keep[[r for r, *_ in shared.value.search(cut.column(text_col))]] = False
                    yield cut.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
