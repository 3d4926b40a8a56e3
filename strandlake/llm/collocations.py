"""Phrases of two to four words that stand together more often than apart, by language (op11), counted in HAT-tries.

Texts are cut into sections of words with a vocabulary each, written once. Words with enough occurrences get ids by falling
count; no candidate can hold another word, so those end phrases as punctuation does. Sections meet the ids of their words in
a join, and a task counts a section in a HAT-trie: hash containers of phrases under a trie of word ids, which burst into a
node and smaller containers as they grow; beyond a bound whole subtrees leave as sorted runs. Each place counts once, with up
to four words; shorter phrases are sums over subtrees. Runs are dealt by prefix partition, the first two words; where both
are among the few hot words, by the words after them too, so no prefix gathers in one task. A partition is sorted and its
runs merged as they stream past, with the sums of all three lengths; only sums that other partitions share (of hot prefixes)
and phrases with enough occurrences leave it.

Null texts are empty, a null language is `und`. An empty table, or one without a phrase that is frequent enough, gives an
empty result. Repeated rows count as often as they stand. Other columns are passed over.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fasta import number_rows
from .common import broadcast_if, drop_stage, release, small_batches, stage_alone, tidy

#: Words of a section, text gathered before it is cut into sections, and the longest phrase.
SECTION, GATHER, LONGEST = 1 << 20, 8 << 20, 4
#: Entries of a container that bursts, and of a trie that spills.
BURST, ENTRIES = 4096, 400_000
#: A word is hot with this share of all occurrences; there are at most as many hot words.
HOT, SALTS = 256, 64
MIN_COUNT, TOP, FACTOR, COVERED = 30, 2000, 2_000_000, 80
SMALL = 400_000
_SECTIONS = "section long, lang string, words array<string>, counts array<long>, ids binary"
_FIRST, _AHEAD = 1, 2
#: A-Z lower, separators of pieces as line feeds, tabs as spaces. UTF-8 has these bytes for these characters only.
_BYTES = bytes(32 if b == 9 else 10 if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _encode(text: bytes) -> list[tuple[list, list, bytes]]:
    """(words, counts, ids) of each section of a text. An id is 4 * word, plus 1 at the start of a piece, plus 2 for words of the next section."""
    raw = np.frombuffer(text.translate(_BYTES), np.uint8)
    letter = (raw != 32) & (raw != 10)
    edge = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return []
    pieces = np.cumsum(raw == 10)[starts]
    first = np.concatenate(([True], pieces[1:] != pieces[:-1]))
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    data = raw[letter]
    out = []
    for a in range(0, len(starts), SECTION):
        b = min(a + SECTION, len(starts))
        c = min(b + LONGEST - 1, len(starts))
        words = pa.Array.from_buffers(pa.large_binary(), c - a, [None, pa.py_buffer(offsets[a : c + 1]), pa.py_buffer(data)]).dictionary_encode()
        local = np.asarray(words.indices)
        ids = (local.astype(np.uint32) << 2) + np.where(first[a:c], _FIRST, 0).astype(np.uint32)
        ids[b - a :] += _AHEAD
        out.append((words.dictionary, np.bincount(local[: b - a], minlength=len(words.dictionary)), ids.tobytes()))
    return out


def _sections(batches):
    """Sections of the texts of a partition, by language."""
    base, done, held, size = TaskContext.get().partitionId() << 32, 0, {}, 0

    def flush():
        nonlocal done
        for lang, texts in held.items():
            for words, counts, ids in _encode(b"\n".join(texts)):
                yield pa.RecordBatch.from_arrays([pa.array([base + done]), pa.array([lang]), pa.array([words.cast(pa.string()).to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([ids], pa.binary())], names=["section", "lang", "words", "counts", "ids"])
                done += 1

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            own = text.as_py() or b""
            held.setdefault(lang, []).append(own)
            size += len(own)
            if size >= GATHER:
                yield from flush()
                held, size = {}, 0
                release()
    yield from flush()
    release()


class HatTrie:
    """Counts of (first id, key), where a key packs three ids of `bits` bits: containers under first ids, burst by second and third ids.

    Beyond `entries` different ones, the subtrees of the largest first ids leave as a sorted run of (first ids, keys, counts).
    """

    def __init__(self, bits: int, burst: int = BURST, entries: int = ENTRIES):
        self.bits, self.burst, self.entries = bits, burst, entries
        self.root: dict[int, Counter | dict] = {}
        self.sizes: Counter = Counter()
        self.total = 0

    def add(self, firsts: np.ndarray, keys: np.ndarray):
        """Counts the pairs; yields the runs that leave."""
        order = np.lexsort((keys, firsts))
        firsts, keys = firsts[order], keys[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(firsts)) + 1, [len(firsts)])) if len(firsts) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first = int(firsts[a])
            node, grown = self._put(self.root.get(first), keys[a:b], 0)
            self.root[first] = node
            self.sizes[first] += grown
            self.total += grown
            if self.total > self.entries:
                yield self._spill(self.entries // 2)

    def _put(self, node, keys: np.ndarray, level: int):
        """The node with the sorted keys counted, and how many of them are new."""
        if node is None:
            node = Counter()
        if isinstance(node, Counter):
            before = len(node)
            node.update(keys.tolist())
            grown = len(node) - before
            return (self._burst(node, level) if len(node) > self.burst and level < LONGEST - 2 else node), grown
        grown = 0
        for k, a, b in self._children(keys, level):
            node[k], more = self._put(node.get(k), keys[a:b], level + 1)
            grown += more
        return node, grown

    def _children(self, keys: np.ndarray, level: int):
        heads = keys >> ((LONGEST - 2 - level) * self.bits)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(heads)) + 1, [len(keys)]))
        return zip(heads[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True)

    def _burst(self, full: Counter, level: int) -> dict:
        keys = np.sort(np.fromiter(full, np.int64, len(full)))
        return {k: Counter({x: full[x] for x in keys[a:b].tolist()}) for k, a, b in self._children(keys, level)}

    def _containers(self, node):
        if isinstance(node, Counter):
            yield node
        else:
            for child in node.values():
                yield from self._containers(child)

    def _spill(self, keep: int):
        """Takes whole subtrees, largest first, until at most `keep` entries are left."""
        gone, left = [], self.total
        for first, n in self.sizes.most_common():
            if left <= keep:
                break
            gone.append(first)
            left -= n
        return self._run(gone)

    def _run(self, gone: list[int]):
        parts = [(first, c) for first in gone for c in self._containers(self.root.pop(first))]
        for first in gone:
            self.total -= self.sizes.pop(first)
        n = sum(len(c) for _, c in parts)
        firsts = np.repeat(np.array([f for f, _ in parts], np.int64), [len(c) for _, c in parts])
        keys = np.fromiter(chain.from_iterable(c for _, c in parts), np.int64, n)
        counts = np.fromiter(chain.from_iterable(c.values() for _, c in parts), np.int64, n)
        order = np.lexsort((keys, firsts))
        return firsts[order], keys[order], counts[order]

    def drain(self):
        """What is left, as a run."""
        return self._run(list(self.root))


def _windows(ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words at each place where a phrase of two or more begins, and up to three after it; 0 beyond its end. known: ranks of the section's words, 0 for rare ones."""
    rank, n = known[ids >> 2], len(ids)
    joined = np.where(ids & _FIRST, 0, rank)
    after = lambda k: np.concatenate((joined[k:], np.zeros(min(k, n), np.int64)))
    second = after(1)
    third = np.where(second > 0, after(2), 0)
    fourth = np.where(third > 0, after(3), 0)
    keep = (rank > 0) & (second > 0) & ((ids & _AHEAD) == 0)
    return rank[keep], second[keep], third[keep], fourth[keep]


def _count(section: pa.Table, words: pa.Table) -> pa.Table:
    """Runs of a section: k1 (first and second word), k2 (third and fourth), c."""
    out = {"k1": [], "k2": [], "c": []}
    for blob in section.column("ids").to_pylist():
        ids = np.frombuffer(blob, np.uint32).astype(np.int64)
        local, wide = np.asarray(words.column("local")).astype(np.int64), np.asarray(words.column("id")).astype(np.int64)
        back = np.concatenate(([0], np.sort(wide)))
        known = np.zeros(int(ids.max() >> 2) + 1, np.int64)
        known[local] = np.searchsorted(back, wide)
        bits = max(1, int(len(back)).bit_length())
        first, second, third, fourth = _windows(ids, known)
        trie = HatTrie(bits)
        runs = [*trie.add(first, (second << (2 * bits)) | (third << bits) | fourth), trie.drain()]
        mask = (1 << bits) - 1
        for f, k, c in runs:
            out["k1"].append((back[f] << 32) | back[k >> (2 * bits)])
            out["k2"].append((back[(k >> bits) & mask] << 32) | back[k & mask])
            out["c"].append(c)
    release()
    return pa.table({k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in out.items()})


class _Sums:
    """Sums over equal neighbouring keys of a sorted stream."""

    def __init__(self):
        self.key, self.sum = None, 0

    def add(self, k1: np.ndarray, k2: np.ndarray, c: np.ndarray):
        """Keys and sums that are complete."""
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1))
        sums = np.add.reduceat(c, cuts)
        k1, k2 = k1[cuts], k2[cuts]
        if self.key is not None:
            if self.key == (k1[0], k2[0]):
                sums[0] += self.sum
            else:
                k1, k2, sums = (np.concatenate(([x], y)) for x, y in ((self.key[0], k1), (self.key[1], k2), (self.sum, sums)))
        self.key, self.sum = (k1[-1], k2[-1]), sums[-1]
        return k1[:-1], k2[:-1], sums[:-1]

    def end(self):
        return tuple(np.array([x], np.int64) for x in (*self.key, self.sum)) if self.key is not None else tuple(np.zeros(0, np.int64) for _ in range(3))


def _merger(hot: int, least: int):
    """Merges the sorted runs of a prefix partition; hot: ids up to it are of hot words."""
    low = (1 << 32) - 1
    is_hot = lambda x: (x > 0) & (x <= hot)

    def kept(size: int, k1: np.ndarray, k2: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        shared = is_hot(k1 >> 32) & is_hot(k1 & low)
        if size == 3:
            shared &= is_hot(k2 >> 32)
        whole = {2: k2 == 0, 3: (k2 >> 32 > 0) & (k2 & low == 0), 4: k2 & low > 0}[size]
        keep = whole & ((c >= least) | (shared if size < LONGEST else False))
        return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (k1, k2, c)], names=["k1", "k2", "c"])

    def merge(batches):
        levels = {size: _Sums() for size in (2, 3, 4)}
        cut = lambda size, k2: k2 * 0 if size == 2 else (k2 >> 32) << 32 if size == 3 else k2
        for batch in (b for b in batches if b.num_rows):
            k1, k2, c = (np.asarray(batch.column(x)) for x in ("k1", "k2", "c"))
            for size, sums in levels.items():
                yield kept(size, *sums.add(k1, cut(size, k2), c))
        for size, sums in levels.items():
            yield kept(size, *sums.end())

    return merge


def _key(words: list[Column]) -> tuple[Column, Column]:
    """k1 and k2 of a phrase of up to four ids."""
    padded = [*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))]
    join = lambda a, b: F.shiftleft(a, 32).bitwiseOR(b)
    return join(*padded[:2]), join(*padded[2:])


def _parts(k1: str, k2: str) -> list[Column]:
    low = F.lit((1 << 32) - 1)
    return [F.shiftright(k1, 32), F.col(k1).bitwiseAND(low), F.shiftright(k2, 32), F.col(k2).bitwiseAND(low)]


def count_phrases(sections: DataFrame, ids: DataFrame, hot: int, least: int = MIN_COUNT) -> DataFrame:
    """k1, k2, a: phrases of two to four words with at least `least` occurrences. ids: id, lang, word, by falling count; the first `hot` ids are hot."""
    words = sections.select("section", "lang", F.posexplode("words").alias("local", "word"))
    own = words.join(broadcast_if(ids.select("id", "lang", "word"), SMALL), ["lang", "word"]).select(F.col("section").alias("of"), "local", "id")
    runs = sections.select("section", "ids").groupBy("section").cogroup(own.groupBy("of")).applyInArrow(_count, "k1 long, k2 long, c long")
    w = _parts("k1", "k2")
    spread = F.when((w[0] <= hot) & (w[1] <= hot), F.when(w[2].between(1, hot), F.xxhash64("k2")).otherwise(F.xxhash64(w[2]))).otherwise(F.lit(0).cast("long"))
    dealt = runs.withColumn("salt", F.pmod(spread, F.lit(SALTS))).repartition("k1", "salt").sortWithinPartitions("k1", "k2").drop("salt")
    merged = dealt.mapInArrow(_merger(hot, least), "k1 long, k2 long, c long")
    return merged.groupBy("k1", "k2").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    a counts the phrase, l and r the two parts of its lowest-scoring cut, n all words of the language; score is
    floor(2000000 * a / (l + r)). Phrases inside a longer one with 80 % of their occurrences or more are dropped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sections = stage_alone(texts.mapInArrow(_sections, _SECTIONS))
    counted = sections.select("lang", F.inline(F.arrays_zip("words", "counts"))).withColumnsRenamed({"words": "word", "counts": "f"}).groupBy("lang", "word").agg(F.sum("f").alias("f"))
    totals = stage_alone(sections.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    ids = number_rows(counted.filter(F.col("f") >= least), "id", F.desc("f"), "lang", "word").withColumn("id", F.col("id") + 1)
    hot = ids.filter(F.col("f") * HOT >= total).count()
    phrases = stage_alone(count_phrases(sections, ids, hot, least))
    drop_stage(sections)
    tidy(spark)
    return _best(phrases, ids, totals, top)


def _best(phrases: DataFrame, ids: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    w = _parts("k1", "k2")
    size = 2 + (w[2] > 0).cast("int") + (w[3] > 0).cast("int")
    counts = phrases.select("k1", "k2", F.col("a").alias("f")).union(ids.select(F.shiftleft("id", 32), F.lit(0).cast("long"), "f"))

    def of(span: range, **more: Column) -> Column:
        k1, k2 = _key([w[i] for i in span])
        return F.struct(k1.alias("p1"), k2.alias("p2"), *[v.alias(k) for k, v in more.items()])

    cuts = [(n, F.struct(F.lit(k).alias("k"), of(range(k)).alias("left"), of(range(k, n)).alias("right"))) for n in range(2, LONGEST + 1) for k in range(1, n)]
    pick = lambda options: F.filter(F.array(*[F.when(size == n, x) for n, x in options]), lambda x: x.isNotNull())
    each = phrases.select("k1", "k2", "a", F.inline(pick(cuts)))
    side = lambda name: counts.select(F.col("k1").alias(f"{name}1"), F.col("k2").alias(f"{name}2"), F.col("f").alias(name))
    each = each.select("k1", "k2", "a", "k", F.col("left.p1").alias("l1"), F.col("left.p2").alias("l2"), F.col("right.p1").alias("r1"), F.col("right.p2").alias("r2"))
    each = each.join(side("l"), ["l1", "l2"]).join(side("r"), ["r1", "r2"])
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * CAST({FACTOR} AS DECIMAL(10, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = each.groupBy("k1", "k2", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("x")).select("k1", "k2", "a", "x.score", "x.l", "x.r")
    inner = [(n, of(range(i, i + m))) for n in range(3, LONGEST + 1) for m in range(2, n) for i in range(n - m + 1)]
    longer = phrases.filter(w[2] > 0).select("a", F.inline(pick(inner))).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.max("a").alias("most"))
    left = lowest.join(longer, ["k1", "k2"], "left").filter(F.coalesce(100 * F.col("most") < COVERED * F.col("a"), F.lit(True))).drop("most")
    named = left.join(ids.select(F.col("id").alias("first"), "lang"), F.shiftright("k1", 32) == F.col("first")).drop("first")
    by = [F.desc("score"), F.desc("a")]
    best = named.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    words = best.select("lang", "k1", "k2", "a", "l", "r", "score", F.posexplode(F.filter(F.array(*w), lambda x: x > 0)).alias("at", "id")).join(ids.select("id", "word"), "id")
    spelt = words.groupBy("lang", "k1", "k2", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x")).withColumn("phrase", F.concat_ws(" ", "x.word"))
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
