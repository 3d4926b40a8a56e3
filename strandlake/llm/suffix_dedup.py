"""Removal of long byte strings that an earlier document has too, by external induced suffix sorting of what can repeat.

Documents are dealt into blocks, those with the same least-hashed 24-byte string, as near copies have, into the same block as
far as it holds them. Each window of `min_len` bytes has an anchor: its least-hashed 24-byte string. Equal
windows have equal anchors, so a window whose anchor is in one document only can't repeat: a first round, a shuffle of packed
anchor hashes answered with packed bits, leaves such windows out. Windows with the same anchor occurrence form a cell; equal
cells of a block, compared byte by byte, are one, and if an anchor has no other cells they are done with. In a second round
the bytes of all cells left meet in shards by anchor.
Every shard is suffix-sorted by external induced sorting, and runs of suffixes whose common prefixes reach min_len give each
window its earliest document. Whether a window repeats is decided by its bytes alone, never by a hash.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, PrefixHash, Stages, broadcast_if, drop_stage, mix64, pick_id_text, release, shared_dir, stage, text_slices, tidy, utf8_bytes
from .induced_sort import ENTRIES, SEPARATOR, Pile, Scratch, blocks, sorted_suffixes

MIN_LEN, ANCHOR = 50, 24
BLOCK_BYTES = 8 << 20
#: An anchor with more cells than this (equal ones of a block count once) is dealt out with the bytes beside it.
HOT_CELLS = 4_096
#: Keys of large groups of near copies that may be broadcast, by count.
BROADCAST_ROWS = 400_000
#: Buckets of the table of blocks; a bucket holds several blocks beyond it.
MAX_BUCKETS = 20_000
#: Ranges of anchors, and of shards. A block sends each at most one message a round, so messages grow with the blocks alone; beyond as many blocks a range's keys are sorted in runs, and a range has several shards.
MAX_RANGES = 4_096
LAST = (1 << 63) - 1
_LOW = U64((1 << 40) - 1)


def _least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every `width` consecutive values."""
    at = np.arange(len(h), dtype=np.int64)
    size = 1
    while size < width:
        step = min(size, width - size)
        right = h[step:] < h[:-step]
        h, at = np.where(right, h[step:], h[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


class Cells:
    """Cells of all documents of a block: anchor hash and place, first and last window, document, and content hash."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, docs: np.ndarray, min_len: int, slice_bytes: int = SLICE_BYTES):
        self.raw, self.off, self.docs, self.min_len = raw, off, docs, min_len
        columns, x = {k: [] for k in ("anchor", "place", "a", "b", "row", "content")}, 0
        while x + min_len <= len(raw):
            cells, x = self._slice(x, min(x + slice_bytes, len(raw)))
            for column, part in zip(columns.values(), cells, strict=True):
                column.append(part)
        for name in [*columns]:
            parts = columns.pop(name)
            setattr(self, name, np.concatenate(parts) if parts else np.zeros(0, U64 if name in ("anchor", "content") else np.int64))
        self.doc = docs[self.row] if len(docs) else np.zeros(0, np.int64)

    def _slice(self, x: int, y: int) -> tuple[tuple, int]:
        """(cells of the windows in raw[x:y], where the next slice begins); a cell that may go on is left to the next slice."""
        m, last = self.min_len, y == len(self.raw)
        raw, n = self.raw[x:y], y - x
        p = PrefixHash(raw)
        h = mix64(p.ranges(np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1)))
        at = _least_in_window(h, m - ANCHOR + 1)
        i, j = int(np.searchsorted(self.off, x, side="right")) - 1, int(np.searchsorted(self.off, y, side="left"))
        begin, end = np.maximum(self.off[i:j], x) - x, np.minimum(self.off[i + 1 : j + 1], y) - x
        ok = end - begin >= m
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, begin[ok], 1)
        np.add.at(inside, end[ok] - m + 1, -1)
        v = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
        where = at[v]
        first = np.ones(len(v), bool)
        first[1:] = where[1:] != where[:-1]
        k = np.flatnonzero(first)
        a, b = v[k], v[np.append(k[1:], len(v)) - 1] if len(k) else v[:0]
        then = y if last else y - m + 1
        if not last and len(b) and b[-1] == n - m and a[-1]:
            then, a, b, k = x + int(a[-1]), a[:-1], b[:-1], k[:-1]
        place = where[k]
        content = mix64(p.ranges(a, b + m) + ((place - a).astype(U64) << U64(32)) + (b - a).astype(U64))
        row = np.searchsorted(self.off, a + x, side="right") - 1
        return (h[place], place + x, a + x, b + x, row, content), then

    def distinct(self, keys: np.ndarray, rows: np.ndarray):
        """(distinct keys, index of each row's key, least and greatest document of each)."""
        uniq, inv = np.unique(keys, return_inverse=True)
        low, high = np.full(len(uniq), LAST), np.full(len(uniq), -(1 << 63))
        np.minimum.at(low, inv, self.doc[rows])
        np.maximum.at(high, inv, self.doc[rows])
        return uniq, inv, low, high


def _deal(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of keys by range, ranges that have keys, bounds of these)."""
    return _runs(((keys >> U64(40)) % U64(n)).astype(np.int64))


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stable order by number, numbers that occur, bounds of these)."""
    order = np.argsort(of, kind="stable")
    found, at = np.unique(of[order], return_index=True)
    return order, found, np.append(at, len(of))


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Five bytes of each key, and one that counts its cells up to 255."""
    wide = (keys & _LOW | np.minimum(counts, 255).astype(U64) << U64(40)).astype("<u8")
    return np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the ranges of raw from a on are equal to those from b on; ranges have eight bytes at least."""
    words = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))
    count = -(-size // 8)
    at = np.minimum(8 * _ragged(np.zeros_like(count), count), np.repeat(size - 8, count))
    return np.logical_and.reduceat(words[np.repeat(a, count) + at] == words[np.repeat(b, count) + at], np.cumsum(count) - count)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all ranges in turn."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unmixed hashes of many short ranges of raw, from their own bytes alone."""
    out = np.zeros(len(start), U64)
    for x, y in blocks(len(start), 20_000):
        end = np.cumsum(size[x:y])
        out[x:y] = PrefixHash(raw[_ragged(start[x:y], size[x:y])]).ranges(end - size[x:y], end)
    return out


SENT = "bucket int, block int, data binary"
ANSWER = "block int, round int, bucket int, data binary"


def _bits(answers: dict, dealt: tuple, which: int, offset: int = 0) -> np.ndarray:
    """Answer bits put back into key order."""
    order, found, bounds = dealt
    out = np.zeros(len(order), bool)
    for k, a, b in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[order[a:b]] = np.unpackbits(np.frombuffer(answers[which, k], np.uint8))[offset * (b - a) :][: b - a].astype(bool)
    return out


class _Block:
    """What every round derives anew from a block's documents and the answers so far."""

    def __init__(self, left: pa.Table, n: int, min_len: int, right: pa.Table | None = None):
        raw, off = utf8_bytes(left.column("text").combine_chunks())
        docs = left.column("doc_id").to_numpy()
        self.block, self.n, self.min_len = left.column("block")[0].as_py(), n, min_len
        self.answers, self.marks = {}, []
        for r, k, d in zip(*[right.column(c).to_pylist() for c in ("round", "bucket", "data")], strict=True) if right is not None else ():
            if r == 1:
                self.answers[r, k] = d
            else:
                self.marks.append(d)
        self.cells = c = Cells(raw, off, docs, min_len)
        self.anchors, self.anchor_of, low, high = c.distinct(c.anchor, np.arange(len(c.a)))
        self.dealt = _deal(self.anchors, n)
        self.several = low != high

    def use_anchors(self) -> None:
        """Cells whose anchor is in two documents or more; equal ones under one number, with their least document."""
        c = self.cells
        elsewhere = _bits(self.answers, self.dealt, 1, 0)
        shared = self.several | elsewhere
        self.hot = _bits(self.answers, self.dealt, 1, 1)
        self.live = np.flatnonzero(shared[self.anchor_of])
        keys, self.key_of, _, _ = c.distinct(c.content[self.live], self.live)
        _, at = np.unique(self.key_of, return_index=True)
        self.sample = self.live[at]
        # Cells of one hash are equal to its sample byte by byte, or get a number of their own.
        other = np.flatnonzero(self.sample[self.key_of] != self.live)
        differ = np.zeros(len(other), bool)
        for x, y in blocks(len(other), 50_000):
            i, j = self.live[other[x:y]], self.sample[self.key_of[other[x:y]]]
            size = c.b[i] - c.a[i] + self.min_len
            odd = (c.b[j] - c.a[j] + self.min_len != size) | (c.place[i] - c.a[i] != c.place[j] - c.a[j])
            differ[x:y] = odd | ~_equal(c.raw, c.a[i], c.a[np.where(odd, i, j)], size)
        odd = other[differ]
        self.key_of[odd] = len(keys) + np.arange(len(odd))
        self.sample = np.concatenate((self.sample, self.live[odd]))
        self.low = np.full(len(self.sample), LAST)
        np.minimum.at(self.low, self.key_of, c.doc[self.live])
        # If all cells of an anchor anywhere are equal, their windows are in no other cell: nothing is left to sort.
        anchor = self.anchor_of[self.sample]
        self.open = np.flatnonzero(elsewhere[anchor] | (np.bincount(anchor, minlength=len(self.anchors)) > 1)[anchor])


def _keyed(batches):
    """doc_id, text, key, size: the hash of the least-hashed anchor of every text (of the whole text where it is shorter)."""
    for batch in batches:
        for cut in text_slices(batch):
            raw, off = utf8_bytes(cut.column("text"))
            size = np.diff(off)
            key = np.full(len(size), U64(0xFFFFFFFFFFFFFFFF))
            short = np.flatnonzero(size < ANCHOR)
            key[short] = mix64(_hashes(raw, off[short], size[short]) + size[short].astype(U64))
            for x, y in blocks(len(raw), SLICE_BYTES):
                piece = raw[x : y + ANCHOR - 1]
                starts = np.arange(max(len(piece) - ANCHOR + 1, 0))
                h = mix64(PrefixHash(piece).ranges(starts, starts + ANCHOR))
                # Places of each text at which a string of it begins; least between the first and the last of them.
                begin, end = np.clip(off[:-1] - x, 0, len(h)), np.clip(off[1:] - ANCHOR + 1 - x, 0, len(h))
                rows = np.flatnonzero(end > begin)
                if len(rows):
                    edges = np.stack((begin[rows], end[rows]), 1).ravel()
                    edges = edges[:-1] if edges[-1] == len(h) else edges
                    key[rows] = np.minimum(key[rows], np.minimum.reduceat(h, edges)[::2])
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("text"), pa.array(key.view(np.int64)), pa.array(size)], names=["doc_id", "text", "key", "size"])


def _in_blocks(base: DataFrame, n: int, block_bytes: int, work: Stages) -> DataFrame:
    """doc_id, text, block. Documents with the same key go to the same block; a key with many bytes is dealt out in pieces."""
    keyed = work.stage(base.mapInArrow(_keyed, "doc_id long, text string, key long, size long"))
    piece = max(block_bytes // 4, 1)
    # At most four keys a block have so many bytes.
    large = keyed.groupBy("key").agg(F.ceil(F.sum("size") / piece).alias("pieces")).filter("pieces > 1")
    both = keyed.join(broadcast_if(large, BROADCAST_ROWS), "key", "left")
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("pieces", F.lit(1)))
    return both.select("doc_id", "text", F.pmod(F.xxhash64("key", salt), F.lit(n)).cast("int").alias("block"))


def _send_anchors(n: int, min_len: int):
    def run(left: pa.Table) -> pa.Table:
        b = _Block(left, n, min_len)
        order, found, bounds = b.dealt
        keys, counts = b.anchors[order], np.bincount(b.anchor_of, minlength=len(b.anchors))[order]
        data = [_packed(keys[x:y], counts[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"bucket": pa.array(found, pa.int32()), "block": pa.array([b.block] * len(found), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


class AnchorRange:
    """The packed anchors of one range, message by message, in sorted runs that go to files beyond the bound of entries."""

    def __init__(self, bucket: int, hot_cells: int, entries: int):
        self.bucket, self.hot_cells, self.scratch = bucket, hot_cells, Scratch(entries)
        self.runs, self.waiting, self.held = [], [], 0

    def add(self, block: int, data: bytes) -> None:
        self.waiting.append((block, np.frombuffer(data, np.uint8).reshape(-1, 6)))
        self.held += len(data) // 6
        if self.held >= self.scratch.entries:
            self._sort()

    def _sort(self) -> None:
        """The messages that wait become a run: blocks, message sizes, keys in order, their places, their cells; and room for answers."""
        if not self.waiting:
            return
        sizes = [len(d) for _, d in self.waiting]
        wide = np.zeros((self.held, 8), np.uint8)
        wide[:, :6] = np.concatenate([d for _, d in self.waiting])
        keys = wide.view("<u8")[:, 0] & _LOW
        order = np.argsort(keys)
        kept = [self.scratch.array(self.held, t) for t in (U64, np.int64, np.uint8)]
        for to, part in zip(kept, (keys[order], order, wide[order, 5]), strict=True):
            to[:] = part
        self.runs.append(([b for b, _ in self.waiting], sizes, *kept, self.scratch.array(self.held, np.uint8)))
        self.waiting, self.held = [], 0

    def answers(self):
        """(block, bits: which of its keys are in another message too, then which are hot)."""
        with self.scratch as scratch:
            self._sort()
            total = sum(len(run[2]) for run in self.runs)
            # Keys are hashes of 40 bits, so equal stretches of them hold about as many.
            n = total // scratch.entries + 1
            edges = [(1 << 40) * k // n for k in range(n + 1)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                at = [np.searchsorted(run[2], np.array([low, high], U64)) for run in self.runs]
                keys = np.concatenate([run[2][a:b] for run, (a, b) in zip(self.runs, at, strict=True)])
                cells = np.concatenate([run[4][a:b] for run, (a, b) in zip(self.runs, at, strict=True)]).astype(np.int64)
                order, _, bounds = _runs(keys)
                start, size = bounds[:-1], np.diff(bounds)
                both = np.empty(len(keys), np.uint8)
                if len(keys):
                    hot = np.add.reduceat(cells[order], start) > self.hot_cells
                    both[order] = np.repeat((size > 1).astype(np.uint8) + 2 * hot.astype(np.uint8), size)
                done = 0
                for run, (a, b) in zip(self.runs, at, strict=True):
                    run[5][a:b] = both[done : done + b - a]
                    done += b - a
            for message_blocks, sizes, _, place, _, found in self.runs:
                bits, at = np.empty(len(place), np.uint8), 0
                bits[place] = found
                for block, size in zip(message_blocks, sizes, strict=True):
                    own = bits[at : at + size]
                    yield block, np.packbits(np.concatenate((own & 1, own >> 1))).tobytes()
                    at += size


def _ranges(batches, begin, finish):
    """Messages in the order of their ranges: each range is begun, given its messages, and finished."""
    now = None
    for batch in batches:
        bucket, block, data = (batch.column(c) for c in ("bucket", "block", "data"))
        for i in range(batch.num_rows):
            k = bucket[i].as_py()
            if now is None or now.bucket != k:
                if now is not None:
                    yield from finish(now)
                now = begin(k)
            now.add(block[i].as_py(), data[i].as_py())
    if now is not None:
        yield from finish(now)


def _answer_rows(rows: list, which: int, bucket: int) -> pa.RecordBatch:
    m = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([which] * m, pa.int32()), pa.array([bucket] * m, pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "round", "bucket", "data"])


def _in_batches(rows, most: int = 1 << 22):
    """Lists of rows of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _answer_anchors(hot_cells: int, entries: int):
    def finish(own: AnchorRange):
        for rows in _in_batches(own.answers()):
            yield _answer_rows(rows, 1, own.bucket)
        release()

    return lambda batches: _ranges(batches, lambda k: AnchorRange(k, hot_cells, entries), finish)


_SNIP = np.dtype([("index", "<u4"), ("shift", "u1"), ("length", "<u2"), ("doc", "<i8")])


def _snippets(b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippets, their places, hashes that deal them out) of the cells that may repeat.

    A cell is dealt by its anchor. One of a hot anchor is cut in two: windows with half of their other bytes before the
    anchor are dealt by those and the anchor, the others by the anchor and as many bytes after it.
    """
    c, own, m = b.cells, b.sample[b.open], b.min_len
    a, e, place, anchor = c.a[own], c.b[own], c.place[own], c.anchor[own]
    near = (m - ANCHOR) // 2
    hot = b.hot[b.anchor_of[own]]
    parts = []
    # From and to: first and last window; then where the string begins that deals them out (if any), and its length.
    for rows, first, last, begin, size in (
        (np.flatnonzero(~hot), a, e, None, 0),
        (np.flatnonzero(hot & (a <= place - near)), a, np.minimum(e, place - near), place - near, near + ANCHOR),
        (np.flatnonzero(hot & (e > place - near)), np.maximum(a, place - near + 1), e, place, m - near + 1),
    ):
        snip = np.zeros(len(rows), _SNIP)
        snip["index"], snip["doc"] = b.open[rows], b.low[b.open[rows]]
        snip["shift"], snip["length"] = first[rows] - a[rows], last[rows] - first[rows] + m
        spread = anchor[rows]
        if begin is not None and len(rows):
            spread = mix64(_hashes(c.raw, begin[rows], np.full(len(rows), size)) + U64(size))
        parts.append((snip, first[rows], spread))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _send_snippets(n: int, min_len: int, n_subs: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shards, block, data = [], [], []
        if left.num_rows:
            b = _Block(left, n, min_len, right)
            b.use_anchors()
            snip, start, spread = _snippets(b)
            spread = mix64(spread)
            # A message holds the shards of a range in turn: their number, then number and bytes of each, then its snippets.
            order, found, bounds = _runs((spread % U64(n) * U64(n_subs) + spread // U64(n) % U64(n_subs)).astype(np.int64))
            parts: dict[int, list] = {}
            for k, x, y in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                mine = order[x:y]
                sent = len(mine).to_bytes(8, "little") + snip[mine].tobytes() + b.cells.raw[_ragged(start[mine], snip["length"][mine].astype(np.int64))].tobytes()
                parts.setdefault(k // n_subs, []).append((k % n_subs, sent))
            shards, block = [*parts], [b.block] * len(parts)
            data = [np.array([len(p)] + [v for k, d in p for v in (k, len(d))], "<i8").tobytes() + b"".join(d for _, d in p) for p in parts.values()]
        return pa.table({"bucket": pa.array(shards, pa.int32()), "block": pa.array(block, pa.int32()), "data": pa.array(data, pa.binary())})

    return run


class Shard:
    """The snippets of one shard, message by message; what is large is in files."""

    def __init__(self, min_len: int, entries: int):
        self.min_len, self.scratch, self.messages = min_len, Scratch(entries), []
        self.snips, self.text = Pile(self.scratch, dtype=_SNIP), Pile(self.scratch, dtype=np.uint8)

    def add(self, block: int, data: bytes) -> None:
        n = int.from_bytes(data[:8], "little")
        snip, raw = np.frombuffer(data, _SNIP, n, 8), np.frombuffer(data, np.uint8, -1, 8 + n * _SNIP.itemsize)
        self.messages.append((block, n))
        self.snips.append(snip)
        self.text.append(np.insert(raw + np.uint8(1), np.cumsum(snip["length"], dtype=np.int64), SEPARATOR).astype(np.uint8))

    def marks(self) -> list[tuple[int, bytes]]:
        """(block, which windows of which of its cells an earlier document has too)."""
        with self.scratch as scratch:
            self.text.append(np.zeros(1, np.uint8))
            text, snip = self.text.array(), self.snips.array()
            # The snippet of every place at which a window begins, else -1.
            start, owners = scratch.array(len(snip), np.int64), scratch.array(len(text), np.int32)
            at = 0
            for a, b in blocks(len(snip), max(scratch.entries // 128, 1)):
                size = snip["length"][a:b].astype(np.int64) + 1
                start[a:b] = at + np.cumsum(size) - size
                own = np.repeat(np.arange(a, b, dtype=np.int32), size)
                own[np.arange(len(own)) + at + self.min_len >= np.repeat(start[a:b] + size, size)] = -1
                owners[at : at + len(own)] = own
                at += len(own)
            owners[at:] = -1
            mask = scratch.array(len(snip), np.uint64)
            for place in repeated_windows(text, owners, snip["doc"], self.min_len, scratch):
                owner = owners[place]
                np.bitwise_or.at(mask, owner, U64(1) << (place - start[owner] + snip["shift"][owner]).astype(U64))
            out, at = [], 0
            for block, n in self.messages:
                k = np.flatnonzero(mask[at : at + n])
                if len(k):
                    pair = np.zeros(len(k), _MARK)
                    pair["index"], pair["mask"] = snip["index"][at + k], mask[at + k]
                    out.append((block, pair.tobytes()))
                at += n
            return out


_MARK = np.dtype([("index", "<u4"), ("mask", "<u8")])
_PART = np.dtype([("shard", "<i8"), ("block", "<i8"), ("at", "<i8"), ("size", "<i8")])


class ShardRange:
    """The messages of one range, taken apart by shard; the bytes go to a file beyond the bound of entries, those of a shard together in each run."""

    def __init__(self, bucket: int, min_len: int, entries: int):
        self.bucket, self.min_len, self.entries, self.scratch = bucket, min_len, entries, Scratch(entries)
        self.index, self.text = Pile(self.scratch, dtype=_PART), Pile(self.scratch, dtype=np.uint8)
        self.waiting, self.held = [], 0

    def add(self, block: int, data: bytes) -> None:
        n = int.from_bytes(data[:8], "little")
        at = 8 + 16 * n
        for shard, size in np.frombuffer(data, "<i8", 2 * n, 8).reshape(-1, 2).tolist():
            self.waiting.append((shard, block, data[at : at + size]))
            at += size
            self.held += size
        if self.held > self.entries:
            self._sort()

    def _sort(self) -> None:
        self.waiting.sort(key=lambda part: part[0])
        part = np.zeros(len(self.waiting), _PART)
        part["size"] = [len(d) for *_, d in self.waiting]
        part["shard"], part["block"] = [s for s, *_ in self.waiting], [b for _, b, _ in self.waiting]
        part["at"] = self.text.n + np.cumsum(part["size"]) - part["size"]
        self.index.append(part)
        self.text.append(np.frombuffer(b"".join(d for *_, d in self.waiting), np.uint8))
        self.waiting, self.held = [], 0

    def marks(self):
        """(block, marks of its cells), shard by shard; few marks of one block are put together."""
        with self.scratch:
            self._sort()
            index, text = self.index.array(), self.text.array()
            order, _, bounds = _runs(index["shard"])
            found: dict[int, list] = {}
            held = 0
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                shard = Shard(self.min_len, self.entries)
                for _, block, at, size in index[order[x:y]].tolist():
                    shard.add(block, text[at : at + size].tobytes())
                for block, data in shard.marks():
                    found.setdefault(block, []).append(data)
                    held += len(data)
                if held > self.entries:
                    yield from ((block, b"".join(d)) for block, d in found.items())
                    found, held = {}, 0
            yield from ((block, b"".join(d)) for block, d in found.items())


def repeated_windows(text: np.ndarray, owners: np.ndarray, doc: np.ndarray, min_len: int, scratch: Scratch):
    """Places of windows of snippets that a snippet of an earlier document has too, part by part."""
    # Equal windows stand side by side, with common prefixes of min_len or more; other suffixes hold a separator before that.
    places, begins = Pile(scratch), Pile(scratch, dtype=bool)
    n_groups = 0
    for place, lcp in sorted_suffixes(text, min_len, scratch):
        inside = owners[place] >= 0
        places.append(place[inside])
        begins.append(lcp[inside] < min_len)
        n_groups += int(np.count_nonzero(lcp[inside] < min_len))
    places, begins = places.array(), begins.array()
    first = scratch.array(n_groups, np.int64)
    first[:] = LAST
    docs = lambda p: doc[owners[p]]
    at = -1
    for a, b in blocks(len(places), scratch.entries):
        group = at + np.cumsum(begins[a:b])
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        first[group[cut]] = np.minimum(first[group[cut]], np.minimum.reduceat(docs(places[a:b]), cut))
        at = int(group[-1])
    at = -1
    for a, b in blocks(len(places), scratch.entries):
        group = at + np.cumsum(begins[a:b])
        yield places[a:b][first[group] < docs(places[a:b])]
        at = int(group[-1])


def _answer_snippets(min_len: int, entries: int):
    def finish(own: ShardRange):
        for rows in _in_batches(own.marks()):
            yield _answer_rows(rows, 2, own.bucket)
        release()

    return lambda batches: _ranges(batches, lambda k: ShardRange(k, min_len, entries), finish)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _report(n: int, min_len: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            b = _Block(left, n, min_len, right)
            b.use_anchors()
            c = b.cells
            mask = np.zeros(len(b.sample), U64)
            for d in b.marks:
                pair = np.frombuffer(d, _MARK)
                np.bitwise_or.at(mask, pair["index"], pair["mask"])
            edge = np.zeros(len(c.raw) + 1, np.int16)  # a window begins and ends once at a place, so sums stay below 2 min_len
            # A cell equal to one of an earlier document of its block repeats whole.
            again = c.doc[b.live] > b.low[b.key_of]
            whole = b.live[again]
            np.add.at(edge, c.a[whole], 1)
            np.add.at(edge, c.b[whole] + min_len, -1)
            part = np.flatnonzero(~again & (mask[b.key_of] != 0))
            for shift in range(min_len - ANCHOR + 1):
                k = b.live[part[(mask[b.key_of[part]] >> U64(shift) & U64(1)).astype(bool)]]
                np.add.at(edge, c.a[k] + shift, 1)
                np.add.at(edge, c.a[k] + shift + min_len, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int16, out=edge[:-1]) > 0
            for i, doc in enumerate(c.docs.tolist()):
                s, e = c.off[i], c.off[i + 1]
                g = gone[s:e]
                change = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans = [{"start": x, "end": y} for x, y in change.reshape(-1, 2).tolist()]
                rows.append((None if doc == LAST else doc, int(e - s), int(g.sum()), len(spans), hashlib.sha256(c.raw[s:e][~g].tobytes()).hexdigest(), spans))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table({k: pa.array(v, t) for (k, t), v in zip((("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS)), cols, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, block_bytes: int = BLOCK_BYTES, hot_cells: int = HOT_CELLS, entries: int = ENTRIES, max_buckets: int = MAX_BUCKETS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges).

    A byte goes if it is covered by a min_len-byte string that also starts in a document with a smaller doc_id; strings are
    judged on the input. min_len is from ANCHOR to ANCHOR + 63. Null and empty texts have no bytes; texts are whole however
    long; null doc_ids come last; rows that share a doc_id don't repeat each other; other columns of docs are ignored; an
    empty table gives no rows. entries bounds what a task that sorts a range holds of an array before it goes to a file.
    """
    if not ANCHOR <= min_len <= ANCHOR + 63:
        raise ValueError(f"min_len must be from {ANCHOR} to {ANCHOR + 63}")
    spark, work = docs.sparkSession, Stages()
    base = pick_id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    n_buckets, ranges = min(n, max_buckets), min(n, max_ranges)
    dealing = Stages()
    dealt = _in_blocks(base, n, block_bytes, dealing)
    # Bucketed by block, so that no later round shuffles the texts again.
    name = f"strandlake_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    dealt.repartition(n_buckets, "block").write.bucketBy(n_buckets, "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    dealing.drop()
    tidy(spark)
    table = spark.table(name)
    table._strandlake_path = path
    try:
        def by_range(sent: DataFrame) -> DataFrame:
            return sent.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "block")

        sent = table.groupBy("block").applyInArrow(_send_anchors(ranges, min_len), SENT)
        answers = work.stage(by_range(sent).mapInArrow(_answer_anchors(hot_cells, entries), ANSWER))
        tidy(spark)
        sent = table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_snippets(ranges, min_len, -(-n // ranges)), SENT)
        answers = answers.union(work.stage(by_range(sent).mapInArrow(_answer_snippets(min_len, entries), ANSWER)))
        tidy(spark)
        out = stage(table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_report(ranges, min_len), REPORT))
        return out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        work.drop()
        drop_stage(table)
