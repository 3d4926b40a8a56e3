"""External induced suffix sorting with common prefixes, vectorised by runs of suffix tuples.

A suffix is of type S if it is smaller than the one after it, else of type L; an S suffix after an L one is leftmost (LMS).
Substrings from one LMS place to the next are sorted and named, the names are a text a half as long or less, and its
suffixes are sorted by the same method, down to names that fit in memory: that recursion gives the order of the LMS suffixes.
All other suffixes are induced: a scan of sorted suffixes in ascending order sorts the L suffixes before them, a scan in
descending order the S suffixes. Suffixes that agree in as many symbols as common prefixes are counted to may stand in any order.

What is scanned and queued are tuples: a place, the symbols before it (so that inducing needs no look at the text), and the
length of the common prefix with the tuple before. A suffix enters the bucket of its first symbol behind those that came
earlier, so the queue is a monotone priority queue keyed by (symbol, arrival). An induced common prefix is one more than the
least of those between the two suffixes that induced its neighbours. Texts, names, queue and sorted runs are in files of
the task's own folder beyond a bound of entries; a lost task starts anew, so nothing depends on them elsewhere.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries that an array, or a queue, holds in memory; larger ones are in files.
ENTRIES = 6_000_000
#: Symbols of a text that is sorted: 0 ends it, bytes are one more than in the text, SEPARATOR is free for callers.
SEPARATOR, _PAD = 0xF6, 0xFF
_GROUPS, _WINDOW = 64, 512


class Scratch:
    """Arrays in memory up to `entries` elements, in files of a folder of its own beyond it."""

    def __init__(self, entries: int = ENTRIES):
        self.entries, self.folder, self.n_files = max(entries, 16), None, 0

    def file(self):
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="sort-")
        self.n_files += 1
        return open(f"{self.folder.name}/{self.n_files}", "w+b")

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.entries:
            return np.zeros(n, dtype)
        with self.file() as f:
            return np.memmap(f, dtype, "w+", shape=(n,))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder is not None:
            self.folder.cleanup()


class Pile:
    """Pieces of an array, appended one by one and read in order or backwards."""

    def __init__(self, scratch: Scratch, shape: tuple = (-1,), dtype=np.int64):
        self.scratch, self.shape, self.dtype, self.pieces, self.held, self.n, self.out = scratch, shape, np.dtype(dtype), [], 0, 0, None

    def append(self, part: np.ndarray) -> None:
        if len(part):
            self.pieces.append(part)
            self.n += len(part)
            self.held += len(part)
            if self.held > self.scratch.entries:
                self.spill()

    def spill(self) -> None:
        """Pieces in memory go to the end of the file."""
        if self.out is None:
            self.out = self.scratch.file()
        self.out.seek(0, 2)
        for i, part in enumerate(self.pieces):
            if isinstance(part, np.ndarray):
                self.pieces[i] = (self.out.tell(), part.size)
                part.tofile(self.out)
        self.out.flush()
        self.held = 0

    def _read(self, part) -> np.ndarray:
        if isinstance(part, tuple):
            self.out.seek(part[0])
            return np.fromfile(self.out, self.dtype, part[1]).reshape(self.shape)
        return part

    def parts(self) -> Iterator[np.ndarray]:
        return map(self._read, self.pieces)

    def backwards(self) -> Iterator[np.ndarray]:
        return (self._read(p)[::-1] for p in reversed(self.pieces))

    def array(self) -> np.ndarray:
        """All pieces as one array, in memory or in a file."""
        if self.n <= self.scratch.entries:
            return np.concatenate([*self.parts()]) if self.pieces else np.zeros(0, self.dtype)
        self.spill()
        return np.memmap(self.out, self.dtype, "r", shape=(self.n,))


class BucketQueue:
    """Priority queue of tuples keyed by (bucket, arrival); beyond the bound its runs are in a file."""

    def __init__(self, n_buckets: int, scratch: Scratch, shape: tuple):
        self.piles: list[list] = [[] for _ in range(n_buckets)]
        self.held, self.scratch, self.shape, self.file = 0, scratch, shape, None

    def push(self, tuples: np.ndarray, buckets: np.ndarray) -> None:
        """Append tuples, in their order, to the runs of their buckets."""
        if not len(tuples):
            return
        order = np.argsort(buckets, kind="stable")
        tuples, buckets = tuples[order], buckets[order]
        cut = np.flatnonzero(np.diff(buckets)) + 1
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(tuples)], strict=True):
            self.piles[buckets[a]].append(tuples[a:e])
        self.held += len(tuples)
        if self.held > self.scratch.entries:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = self.scratch.file()
        self.file.seek(0, 2)
        for run in self.piles:
            for i, part in enumerate(run):
                if isinstance(part, np.ndarray):
                    run[i] = (self.file.tell(), part.size)
                    part.tofile(self.file)
        self.file.flush()
        self.held = 0

    def pop(self, bucket: int) -> Iterator[np.ndarray]:
        """The tuples that wait in a bucket now, in arrival order, in parts of bounded size."""
        run, self.piles[bucket] = self.piles[bucket], []
        parts, n = [], 0
        for part in run:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, np.int64, part[1]).reshape(self.shape)
            else:
                self.held -= len(part)
            parts.append(part)
            n += len(part)
            if n > self.scratch.entries:
                yield np.concatenate(parts)
                parts, n = [], 0
        if parts:
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive blocks."""
    return ((a, min(a + size, n)) for a in range(0, n, size))


def lms_places(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """LMS places in ascending order, the closing 0's last; the text is read once, from its end."""
    n = len(text)
    out = Pile(scratch)
    after = True  # type of the place after the block: the closing 0 is S
    found = [np.array([n - 1])]
    for a, b in reversed([*blocks(n - 1, scratch.entries)]):
        s = text[a : b + 1].astype(np.int64)
        step = np.sign(np.diff(s))
        at = np.where(step != 0, np.arange(b - a), b - a)
        nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
        small = np.append(np.where(nearest < b - a, step[np.minimum(nearest, b - a - 1)] > 0, after), after)
        # The place before a block is judged with the block before it.
        first = np.flatnonzero(small[1:] & ~small[:-1]) + 1 + a
        found.append(first[first < n - 1][::-1])
        after = bool(small[0])
        if sum(map(len, found)) > scratch.entries:
            out.append(np.concatenate(found))
            found = []
    out.append(np.concatenate(found) if found else np.zeros(0, np.int64))
    places = scratch.array(out.n, np.int64)
    end = out.n
    for part in out.parts():
        places[end - len(part) : end] = part[::-1]
        end -= len(part)
    return places


def ordered(keys: tuple[np.ndarray, ...], scratch: Scratch) -> np.ndarray:
    """A permutation that sorts rows by their keys: sorted runs in files, merged block by block, beyond the bound."""
    n = len(keys[0])
    if n <= scratch.entries:
        return np.lexsort(keys[::-1])
    runs = []
    for a, b in blocks(n, scratch.entries):
        order = np.lexsort([k[a:b] for k in keys[::-1]])
        own = [scratch.array(scratch.entries + 1, k.dtype)[: b - a] for k in keys] + [scratch.array(scratch.entries + 1, np.int64)[: b - a]]
        for to, k in zip(own, keys, strict=False):
            to[:] = k[a:b][order]
        own[-1][:] = order + a
        runs.append(own)
    out, done, at = scratch.array(n, np.int64), 0, [0] * len(runs)
    step = max(scratch.entries // len(runs), 1)

    def until(own: list, a: int, b: int, bound: tuple) -> int:
        for k, x in zip(own, bound, strict=False):  # rows of own[a:b] up to the bound, key by key
            low = a + int(np.searchsorted(k[a:b], x, side="left"))
            high = a + int(np.searchsorted(k[a:b], x, side="right"))
            if k is own[-2]:
                return high
            a, b = low, high
            if a == b:
                return a
        return b

    while done < n:
        live = [r for r in range(len(runs)) if at[r] < len(runs[r][-1])]
        ends = {r: min(at[r] + step, len(runs[r][-1])) for r in live}
        more = [tuple(k[ends[r] - 1] for k in runs[r][:-1]) for r in live if ends[r] < len(runs[r][-1])]
        bound = min(more) if more else None
        parts = []
        for r in live:
            e = ends[r] if bound is None else until(runs[r], at[r], ends[r], bound)
            parts.append([k[at[r] : e] for k in runs[r]])
            at[r] = e
        merged = [np.concatenate([p[i] for p in parts]) for i in range(len(keys) + 1)]
        order = np.lexsort(merged[-2::-1])
        out[done : done + len(order)] = merged[-1][order]
        done += len(order)
    return out


def _key(text: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """`width` symbols from each start on, packed into 64 bits, as _PAD (the highest) from the end on."""
    bits = 64 // width
    pad, out = (1 << bits) - 1, np.zeros(len(start), np.uint64)
    for k in range(width):
        at = start + k
        out = (out << np.uint64(bits)) | np.where(at < end, text[np.minimum(at, len(text) - 1)].astype(np.uint64), np.uint64(pad))
    return out


def name_substrings(text: np.ndarray, lms: np.ndarray, width: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """(names from 1 on of the substrings between LMS places, in text order, then a 0; how many names there are).

    A substring that another one begins with is the greater: it ends in an S suffix where the other goes on with an L one.
    """
    m = len(lms) - 1
    key = scratch.array(m, np.uint64)
    for a, b in blocks(m, scratch.entries):
        key[a:b] = _key(text, lms[a:b], lms[a + 1 : b + 1] + 1, width)
    order = ordered((key,), scratch)
    names = scratch.array(m + 1, np.uint32)
    group = scratch.array(m, np.int64)  # by rank: the first rank of its like
    last, begin = None, 0
    for a, b in blocks(m, scratch.entries):
        v = key[order[a:b]]
        new = np.ones(b - a, bool)
        new[1:] = v[1:] != v[:-1]
        new[0] = last is None or v[0] != last
        last = v[-1]
        first = np.maximum.accumulate(np.where(new, np.arange(a, b), -1))
        group[a:b] = np.where(first < 0, begin, first)
        begin = int(group[b - 1])
    depth = width
    while True:
        # Ranks that are tied, and whose substrings do not end before this depth (a pad tells those that end at it).
        tied = Pile(scratch)
        for a, b in blocks(m, scratch.entries):
            g = group[a : min(b + 1, m)]
            same = np.zeros(b - a, bool)
            same[: len(g) - 1] = g[1:] == g[:-1] if len(g) > b - a else np.append(g[1:] == g[:-1], False)[: len(g) - 1]
            own = g[: b - a] != np.arange(a, b)
            i = order[a:b]
            tied.append(np.flatnonzero((same | own) & (lms[i + 1] + 1 - lms[i] >= depth)) + a)
        if not tied.n:
            break
        at = tied.array()
        k2, g2 = scratch.array(len(at), np.uint64), scratch.array(len(at), np.int64)
        for a, b in blocks(len(at), scratch.entries):
            i = order[at[a:b]]
            k2[a:b], g2[a:b] = _key(text, lms[i] + depth, lms[i + 1] + 1, width), group[at[a:b]]
        inner = ordered((g2, k2), scratch)
        # Tied substrings all reach this depth or all end before it, so these are whole groups.
        moved = scratch.array(len(at), np.int64)
        for a, b in blocks(len(at), scratch.entries):
            moved[a:b] = order[at[inner[a:b]]]
        was = None
        for a, b in blocks(len(at), scratch.entries):
            order[at[a:b]] = moved[a:b]
            j = inner[a:b]
            g, v = g2[j], k2[j]
            new = np.ones(b - a, bool)
            new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            new[0] = was is None or was[:2] != (g[0], v[0])
            first = np.maximum.accumulate(np.where(new, at[a:b], -1))
            first = np.where(first < 0, was[2] if was else -1, first)
            group[at[a:b]] = first
            was = (g[-1], v[-1], int(first[-1]))
        depth += width
    n_names = 0
    for a, b in blocks(m, scratch.entries):
        new = group[a:b] == np.arange(a, b)
        names[order[a:b]] = n_names + np.cumsum(new)
        n_names += int(new.sum())
    return names, n_names


class _Prefixes:
    """Common prefixes of induced tuples: for every symbol, the least since a tuple was last induced to it."""

    def __init__(self, depth: int):
        self.depth, self.low, self.fresh = depth, np.full(256, 255, np.uint8), np.ones(256, bool)

    def induced(self, lcp: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """lcp of a batch in scan order; at, target: which of them induce, and to which symbol."""
        out = np.zeros(len(at), np.uint8)
        if len(at):
            table, width = [lcp], 1
            while 2 * width <= len(lcp):
                table.append(np.minimum(table[-1][:-width], table[-1][width:]))
                width *= 2
            order = np.argsort(target, kind="stable")
            t, k = target[order], at[order]
            first = np.ones(len(k), bool)
            first[1:] = t[1:] != t[:-1]
            begin = np.where(first, 0, np.append(0, k[:-1] + 1))
            level = np.frexp((k + 1 - begin).astype(np.float64))[1] - 1
            least = np.empty(len(k), np.uint8)
            for j in np.unique(level).tolist():
                own = np.flatnonzero(level == j)
                least[own] = np.minimum(table[j][begin[own]], table[j][k[own] + 1 - (1 << j)])
            f = np.flatnonzero(first)
            least[f] = np.minimum(least[f], self.low[t[f]])
            value = np.minimum(least.astype(np.int32) + 1, self.depth)
            value[f[self.fresh[t[f]]]] = 0
            self.fresh[t[f]] = False
            out[order] = value
            ends = np.append(f[1:], len(k)) - 1
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            np.minimum(self.low, after[0], out=self.low)
            self.low[t[ends]] = after[k[ends] + 1]
        elif len(lcp):
            np.minimum(self.low, lcp.min(), out=self.low)
        return out


class _Level:
    """One text, of bytes or of names, and the induction of its suffixes.

    A tuple of a text of bytes is one number: the place in 40 bits, the two symbols before it, whether both are there still,
    and the common prefix in 7 bits. A tuple of a text of names is a row of two: symbol and symbol before, and place.
    """

    def __init__(self, text: np.ndarray, depth: int, scratch: Scratch):
        self.text, self.depth, self.scratch, self.bytes = text, depth, scratch, text.dtype == np.uint8
        self.shape = (-1,) if self.bytes else (-1, 2)
        if self.bytes:
            self.edges = np.arange(257)
        else:  # groups of names with about as many places each; a name with very many is alone
            count = np.zeros(int(text.max()) + 2, np.int64)
            for a, b in blocks(len(text), scratch.entries):
                part = np.bincount(text[a:b])
                count[: len(part)] += part
            total = np.cumsum(count)
            share = max(min(len(text) // _GROUPS, scratch.entries // 4), 1)
            self.edges = np.unique(np.append(np.searchsorted(total, np.arange(share, total[-1] + share, share)) + 1, [0, len(count)]))

    def bucket(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.bytes else np.searchsorted(self.edges, symbols, side="right") - 1

    def place(self, t: np.ndarray) -> np.ndarray:
        return t >> 24 if self.bytes else t[:, 1]

    def _look(self, pos: np.ndarray, lcp) -> np.ndarray:
        """Tuples of bytes whose symbols are looked up."""
        one, two = (self.text[np.maximum(pos - k, 0)].astype(np.int64) for k in (1, 2))
        return pos << 24 | two << 16 | one << 8 | 128 | lcp

    def tuples(self, pos: np.ndarray, lcp: np.ndarray | None) -> np.ndarray:
        if self.bytes:
            return self._look(pos, lcp)
        return np.stack((self.text[pos].astype(np.int64) << 32 | self.text[np.maximum(pos - 1, 0)], pos), 1)

    def before(self, t: np.ndarray) -> np.ndarray:
        """Symbols before the places."""
        return t >> 8 & 255 if self.bytes else t[:, 0] & 0xFFFFFFFF

    def predecessors(self, t: np.ndarray, target: np.ndarray, lcp: np.ndarray | None) -> np.ndarray:
        """Tuples of the places before, whose symbols are target."""
        if not self.bytes:
            pos = t[:, 1] - 1
            return np.stack((target << 32 | self.text[np.maximum(pos - 1, 0)], pos), 1)
        out = (t >> 24) - 1 << 24 | t >> 8 & 0xFF00 | lcp
        spent = np.flatnonzero(t & 128 == 0)
        if len(spent):
            out[spent] = self._look(out[spent] >> 24, lcp[spent])
        return out

    def common(self, p: int, q: int) -> int:
        x, y = self.text[p : p + self.depth], self.text[q : q + self.depth]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix, up to depth, of each place with the one before it in order (0 for the first)."""
        out, last = self.scratch.array(len(order), np.uint8), len(self.text) - 1
        for a, b in blocks(len(order), 1 << 15):
            p = np.asarray(order[max(a - 1, 0) : b], np.int64)
            n, same = np.zeros(len(p) - 1, np.uint8), np.arange(len(p) - 1)
            for k in range(self.depth):  # pairs that agree so far; the closing 0 is there once, so no pair agrees beyond it
                same = same[self.text[np.minimum(p[same] + k, last)] == self.text[np.minimum(p[same + 1] + k, last)]]
                n[same] = k + 1
                if len(same) < 16:
                    n[same] = [self.common(int(p[i]), int(p[i + 1])) for i in same]
                    break
            out[a + (a == 0) : b] = n
        return out

    def induce(self, static: list, down: bool) -> list[Pile]:
        """Scan buckets upwards for L suffixes, or down for S suffixes; static[b] gives a bucket's sorted tuples in scan order.

        Within a symbol queued tuples come first. Returns the induced tuples of every bucket in scan order.
        """
        n = len(self.edges) - 1
        queue, out = BucketQueue(n, self.scratch, self.shape), [Pile(self.scratch, self.shape) for _ in range(n)]
        prefixes = _Prefixes(self.depth) if self.bytes else None
        for b in reversed(range(n)) if down else range(n):
            if self.edges[b + 1] - self.edges[b] == 1:
                self._one_symbol(b, static[b], queue, out[b], prefixes, down)
            else:
                self._group(b, static[b], queue, out[b], down)
        return out

    def _one_symbol(self, b: int, static, queue: BucketQueue, out: Pile, prefixes: _Prefixes | None, down: bool) -> None:
        c, last = int(self.edges[b]), None

        def scan(t: np.ndarray, strict: bool) -> None:
            target = self.before(t)
            beyond = (target < c if strict else target <= c) if down else (target > c if strict else target >= c)
            at = np.flatnonzero(beyond & (self.place(t) > 0))
            target = target[at]
            lcp = prefixes.induced((t & 127).astype(np.uint8), at, target) if prefixes else None
            queue.push(self.predecessors(t[at], target, lcp), self.bucket(target))

        while queue.piles[b]:
            for t in queue.pop(b):
                out.append(t)
                last = int(self.place(t[-1:])[0])
                scan(t, False)
        for t in static():
            if len(t):
                if prefixes and last is not None:
                    t = _with_first(t, self.common(last, int(t[0] >> 24)))
                last = None
                scan(t, True)

    def _group(self, b: int, static, queue: BucketQueue, out: Pile, down: bool) -> None:
        """A bucket of several names: windows of them in scan order, as far as what they induce can't come in between."""
        sign, low, high = -1 if down else 1, self.edges[b], self.edges[b + 1]
        rank = lambda t: sign * (t[:, 0] >> 32)

        def by_symbol(parts: list) -> np.ndarray:
            t = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
            return t[np.argsort(rank(t), kind="stable")]

        wait, still = by_symbol([*queue.pop(b)]), by_symbol([*static()])
        wait_rank, still_rank = rank(wait), rank(still)
        i = j = 0
        while i < len(wait) or j < len(still):
            both = np.sort(np.concatenate((wait_rank[i : i + _WINDOW], still_rank[j : j + _WINDOW])))
            end = int(both[min(len(both), _WINDOW) - 1]) + 1
            k, m = np.searchsorted(wait_rank, end), np.searchsorted(still_rank, end)
            now, fixed, more = wait[i:k], still[j:m], []
            i, j = k, m
            while len(now) or len(fixed):
                t = np.concatenate((now, fixed))
                flag = np.zeros(len(t), np.int64)
                flag[len(now) :] = 1
                own = 2 * rank(t) + flag
                order = np.argsort(own, kind="stable")
                t, own, flag = t[order], own[order], flag[order]
                target = 2 * sign * (t[:, 0] & 0xFFFFFFFF)
                live = (t[:, 1] > 0) & (target >= own)  # for fixed ones, whose own is odd, strictly
                # A tuple can be scanned unless one before it in this window induces a tuple that comes before it.
                least = np.minimum.accumulate(np.where(live, target, 1 << 62))
                bad = own[1:] >= least[:-1]
                if own[0] & 1 == 0:
                    bad[: np.searchsorted(own, own[0], side="right") - 1] = False
                cut = int(bad.argmax()) + 1 if bad.any() else len(t)
                out.append(t[:cut][flag[:cut] == 0])
                at = np.flatnonzero(live[:cut])
                symbols = t[at, 0] & 0xFFFFFFFF
                new = self.predecessors(t[at], symbols, None)
                near = (symbols >= low) & (symbols < high)
                queue.push(new[~near], self.bucket(symbols[~near]))
                now = t[cut:][flag[cut:] == 0]
                fixed = t[cut:][flag[cut:] == 1]
                if near.any():
                    new = new[near]
                    inside = rank(new) < end
                    more.append(new[~inside])
                    now = by_symbol([now, new[inside]])
            if more:
                wait = by_symbol([wait[i:], *more])
                wait_rank, i = rank(wait), 0


def _with_first(t: np.ndarray, lcp: int) -> np.ndarray:
    """Tuples of bytes with another common prefix for the first of them."""
    t = t.copy()
    t[0] = t[0] & ~127 | lcp
    return t


def _cut(array: np.ndarray, a: int, b: int, size: int):
    return lambda: (array[x + a : y + a] for x, y in blocks(b - a, size))


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of names that fit in memory, by ever twice as many names where they are tied.

    A name stands for two bytes at least; suffixes that agree in depth bytes may stay tied.
    """
    order = np.argsort(names, kind="stable")
    rank, n, k = np.empty(len(names), np.int64), len(names), 1
    v = names[order]
    rank[order] = np.maximum.accumulate(np.where(np.append(True, v[1:] != v[:-1]), np.arange(n), 0))
    while 2 * k < depth:
        g = rank[order]
        same = g[1:] == g[:-1]
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(at):
            break
        p = order[at]
        more = np.where(p + k < n, rank[np.minimum(p + k, n - 1)], -1)
        inner = np.argsort(g[at] << 32 | more + 1, kind="stable") if n < 1 << 31 else np.lexsort((more, g[at]))
        p, more = p[inner], more[inner]
        order[at] = p
        new = np.append(True, (g[at][1:] != g[at][:-1]) | (more[1:] != more[:-1]))
        rank[p] = np.maximum.accumulate(np.where(new, at, 0))
        k *= 2
    return order


def _sorted_parts(text: np.ndarray, depth: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(places, common prefixes with the place before) of a text that ends in its only 0, in the order of its suffixes."""
    if text.dtype != np.uint8 and len(text) <= scratch.entries:
        yield _by_doubling(text, depth), None
        return
    level = _Level(text, depth, scratch)
    lms = lms_places(text, scratch)
    m = len(lms) - 1
    seeds = scratch.array(m + 1, np.int64)
    seeds[0] = lms[m]
    if m:
        names, n_names = name_substrings(text, lms, 8 if level.bytes else 2, scratch)
        if n_names == m:
            seeds[names[:m]] = lms[:m]
        else:
            done = 1
            for part, _ in _sorted_parts(names, depth, scratch):
                part = part[part < m]
                seeds[done : done + len(part)] = lms[part]
                done += len(part)
    lcp = level.neighbours(seeds) if level.bytes else None
    first = scratch.array(m + 1, text.dtype)
    tuples = scratch.array((m + 1) * (1 if level.bytes else 2), np.int64).reshape(level.shape)
    for a, b in blocks(m + 1, scratch.entries):
        first[a:b] = text[seeds[a:b]]
        tuples[a:b] = level.tuples(seeds[a:b], lcp[a:b] if level.bytes else None)
    bounds = np.searchsorted(first, level.edges).tolist()
    if level.bytes:
        bounds[-1] = m + 1
    n = len(level.edges) - 1
    large = level.induce([_cut(tuples, bounds[b], bounds[b + 1], scratch.entries) for b in range(n)], False)
    small = level.induce([_backwards(large[b], level.bytes) for b in range(n)], True)
    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)
    for b in range(n):
        if not level.bytes and level.edges[b + 1] - level.edges[b] > 1:
            t = np.concatenate([np.zeros((0, 2), np.int64), *large[b].parts(), *small[b].backwards()])
            yield t[np.argsort(t[:, 0] >> 32, kind="stable"), 1], None
            continue
        last = None
        for t in large[b].parts():
            last = int(level.place(t[-1:])[0])
            yield level.place(t), (t & 127).astype(np.uint8) if level.bytes else None
        for t in _backwards(small[b], level.bytes)():
            if level.bytes and last is not None:
                t = _with_first(t, level.common(last, int(t[0] >> 24)))
            last = None
            yield level.place(t), (t & 127).astype(np.uint8) if level.bytes else None


def _backwards(pile: Pile, with_lcp: bool):
    """Tuples in reverse: the common prefix of two neighbours then belongs to the other one."""

    def run():
        carried = 0
        for t in pile.backwards():
            if with_lcp:
                own = t & 127
                t = t & ~127
                t[1:] |= own[:-1]
                t[0] |= carried
                carried = int(own[-1])
            yield t

    return run


def sorted_suffixes(text: np.ndarray, depth: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes) of all suffixes of a text of bytes 1 to SEPARATOR that ends in a 0, in order, part by part.

    A common prefix is that with the place before, up to depth (at most 127) symbols.
    """
    if depth > 127:
        raise ValueError("depth must be 127 at most")
    for places, lcp in _sorted_parts(text, depth, scratch):
        live = places < len(text) - 1
        yield places[live], lcp[live]
