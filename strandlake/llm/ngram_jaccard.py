"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops them early, the rest are verified exactly.

Documents with the same set of five-word shingles are one node, so copies never multiply pairs. Nodes that share a band of
MinHash values meet in a bucket. Inside a bucket, MinHash values are compared a few at a time, and a pair is dropped once
the posterior probability that its similarity reaches the threshold falls below the tolerance. Members that are left with a
candidate meet once more with their whole shingle sets, and candidates are verified. A bucket's task returns its members
with counts and a spanning star, never its pairs; buckets beyond BLOCK nodes are dealt out as pairs of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Stages, broadcast_if, drop_stage, mix64, pick_id_text, shingle_hashes, stage, text_slices, tidy, utf8_bytes, word_hashes, word_spans

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8**3)**21 = 3e-7, one of 0.85 with 3e-9.
HASHES, BANDS, ROWS = 64, 21, 3
_BAND_BITS = 31
STEP, TOLERANCE = 16, 1e-7
BLOCK = 1024
#: Nodes whose keys may be broadcast to pick their texts; beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 400_000

_A = mix64(np.arange(1, HASHES + 1, dtype=U64)) | U64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Fewest matches among n compared values at which P(similarity >= threshold) is still at least the tolerance.

    The prior is uniform, so the posterior after m of n matches is Beta(m+1, n-m+1), and its upper tail is the chance of
    at most m successes among n+1 trials of probability `threshold`.
    """
    from math import comb

    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each row; row offsets) of lower-cased texts."""
    import pyarrow.compute as pc

    raw, off = utf8_bytes(pc.utf8_lower(col))
    starts, ends, rows = word_spans(raw, off)
    sh, _, at = shingle_hashes(word_hashes(raw, starts, ends), rows, len(off) - 1, SHINGLE)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    first = np.ones(len(sh), bool)
    first[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[first], np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(at) - 1))))


def _nodes(sets: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A 16-byte hash of each row's set; None for an empty one."""
    raw = sets.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x HASHES MinHash values, 16 bits each, of non-empty rows (zeros for empty ones).

    Different values agree in 16 bits once in 65,536 times, which only adds candidates.
    """
    live = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, HASHES), np.uint16)
    if len(live):
        at = off[:-1][live]
        for k in range(HASHES):
            out[live, k] = mix64(np.minimum.reduceat(sets * _A[k], at)) >> U64(48)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS keys; the low bits of a key are its band."""
    s = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(U64)
    key = np.zeros((len(sig), BANDS), U64)
    for r in range(ROWS):
        key = mix64(key ^ (s[:, :, r] + U64(r + 1 << 40)))
    return key & ~U64(_BAND_BITS) | np.arange(BANDS, dtype=U64)


def _sign(batches):
    """The node, shingle count and MinHash values of every text."""
    for batch in batches:
        for cut in text_slices(batch, max_bytes=1 << 20):
            sets, off = shingle_sets(cut.column("text"))
            sig = signatures(sets, off)
            cols = [pa.array(_nodes(sets, off), pa.binary()), pa.array(np.diff(off).astype(np.int32)), pa.array([s.tobytes() for s in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("th"), *cols], names=["doc_id", "th", "node", "size", "sig"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), HASHES)


def _bands(batches):
    for b in batches:
        for a in range(0, b.num_rows, 4000):
            s = b.slice(a, 4000)
            keys = band_keys(_matrix(s.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.column("vid").to_numpy(), BANDS)), pa.array(keys.view(np.int64).ravel())], names=["vid", "key"])


def _with_sets(batches):
    """Shingle sets of wanted texts; a task gives each node once, though equal rows may repeat it."""
    given: set[int] = set()
    for batch in batches:
        for cut in text_slices(batch, max_bytes=1 << 20):
            vid = cut.column("vid").to_pylist()
            new = [v not in given and not given.add(v) for v in vid]
            cut = cut.filter(pa.array(new, pa.bool_()))
            sets, off = shingle_sets(cut.column("text"))
            raw = sets.tobytes()
            data = [raw[8 * a : 8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([cut.column("vid"), pa.array(data, pa.binary())], names=["vid", "shingles"])


class Bucket:
    """Nodes of one bucket, or of a pair of its blocks, and the pairs among them that the comparison of MinHash values leaves."""

    def __init__(self, table: pa.Table, threshold: float, least: dict[int, int]):
        # Equal rows can bring a node twice.
        self.vid, first = np.unique(table.column("vid").to_numpy(), return_index=True)
        self.table = table = table.take(pa.array(first))
        self.sig, self.size = _matrix(table.column("sig").combine_chunks()), table.column("size").to_numpy().astype(np.int64)
        self.keys, self.side = band_keys(self.sig), table.column("block").to_numpy()
        self.band = table.column("key")[0].as_py() & _BAND_BITS
        self.lonely = table.column("bx")[0].as_py() == table.column("by")[0].as_py()
        self.threshold, self.least = threshold, least

    def pairs(self):
        """(i, every j > i that stays a candidate): sizes allow the threshold, and the posterior never fell below the tolerance."""
        for i in range(len(self.vid) - 1):
            js = np.arange(i + 1, len(self.vid))
            if not self.lonely:
                js = js[self.side[js] != self.side[i]]
            low, high = np.minimum(self.size[i], self.size[js]), np.maximum(self.size[i], self.size[js])
            js = js[low >= self.threshold * high - 1e-9]
            if self.band and len(js):  # a pair belongs to the first band that it shares
                js = js[~(self.keys[js, : self.band] == self.keys[i, : self.band]).any(1)]
            match = np.zeros(len(js), np.int64)
            for n, need in self.least.items():
                if not len(js):
                    break
                match = match + (self.sig[js, n - STEP : n] == self.sig[i, n - STEP : n]).sum(1)
                ok = match >= need
                js, match = js[ok], match[ok]
            if len(js):
                yield i, js

    def candidates(self) -> pa.Table:
        """The members that are in a candidate pair here."""
        mark = np.zeros(len(self.vid), bool)
        for i, js in self.pairs():
            mark[i] = True
            mark[js] = True
        return self.table.select(["key", "bx", "by", "block", "vid", "copies", "size", "sig"]).filter(pa.array(mark))

    def links(self) -> pa.Table:
        """Verified on whole shingle sets: each member's number of linked documents, and the least node of its links' component."""
        m = len(self.vid)
        sets = [np.frombuffer(s, U64) for s in self.table.column("shingles").to_pylist()]
        copies = self.table.column("copies").to_numpy()
        flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        off = np.concatenate(([0], np.cumsum(self.size)))
        mark = np.zeros(len(flat), bool)
        links, parent = np.zeros(m, np.int64), list(range(m))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, js in self.pairs():
            mine = inverse[off[i] : off[i + 1]]
            mark[mine] = True
            n = self.size[js]
            at = np.cumsum(n) - n
            both = np.add.reduceat(mark[inverse[np.arange(n.sum()) + np.repeat(off[js] - at, n)]], at, dtype=np.int64)
            mark[mine] = False
            js = js[both >= self.threshold * (self.size[i] + n - both) - 1e-9]
            if len(js):
                links[i] += copies[js].sum()
                links[js] += copies[i]
                for j in js.tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[b] = a
        roots = np.array([root(i) for i in range(m)])
        star = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(star, roots, self.vid)
        keep = links > 0
        return pa.table({"vid": self.vid[keep], "links": links[keep], "star": star[roots][keep]})


def connected(edges: DataFrame) -> DataFrame:
    """v, root: the least vertex of each vertex's component, from (a, b) edges, by alternating large and small stars.

    Neighbour lists are never gathered: each step is a minimum per vertex joined back to the edges.
    """

    def named(df: DataFrame) -> DataFrame:
        out = df.select(F.col("b").alias("v"), F.col("a").alias("root"))
        out._strandlake_path = df._strandlake_path
        return out

    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    if e.isEmpty():
        return named(e)

    def check(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    was = check(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # Small star: every vertex links its smaller neighbours, and itself, to the least of them.
        least = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        small = large.select("a", F.col("b").alias("v")).join(least, "v").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        before, e = e, stage(small.filter("a <> b").distinct())
        drop_stage(before)
        now = check(e)
        if now == was:
            return named(e)
        was = now


def _text_key(text) -> object:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node of every row; node, comp, class_id, n_links of nodes that have copies or links), both staged.

    th is a hash of the text, node one of its shingle set (null if empty), comp a number of the node's component.
    """
    base = pick_id_text(docs, id_col, text_col).select("doc_id", _text_key(F.col("text")).alias("th"), "text")
    work = Stages()
    signed = stage(base.mapInArrow(_sign, "doc_id long, th binary, node binary, size int, sig binary"))
    # One row per distinct shingle set, under a number of its own, with the row that gives its text and its number of copies.
    grouped = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("from"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    nodes = work.stage(grouped.withColumn("vid", F.monotonically_increasing_id()))
    bands = nodes.select("vid", "sig").mapInArrow(_bands, "vid long, key long")
    shared = work.stage(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    near = work.stage(bands.join(broadcast_if(shared, BROADCAST_ROWS), "key"))
    # Of buckets with the same members only that of the lowest band is needed.
    alike = near.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("vid")).alias("x"), F.bit_xor(F.xxhash64("vid", F.lit(1))).alias("y"))
    kept = alike.groupBy("n", "x", "y").agg(F.min_by("key", F.col("key").bitwiseAND(_BAND_BITS)).alias("key")).select("key")
    members = near.join(broadcast_if(kept, BROADCAST_ROWS), "key", "left_semi").join(nodes.select("vid", "copies", "size", "sig"), "vid")
    n_blocks = F.ceil(F.col("n") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("vid"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    dealt = dealt.select("key", F.least("block", "other").alias("bx"), F.greatest("block", "other").alias("by"), "block", "vid", "copies", "size", "sig")
    least = least_matches(threshold)
    narrow = "key long, bx int, by int, block int, vid long, copies long, size int, sig binary"
    # First on MinHash values alone, so that only members with a candidate bring their shingle sets.
    n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, near.count() // (4 * BLOCK))
    candidates = work.stage(dealt.repartition(n_tasks, "key", "bx", "by").groupBy("key", "bx", "by").applyInArrow(lambda t: Bucket(t, threshold, least).candidates(), narrow))
    tidy(docs.sparkSession)
    wanted = nodes.join(candidates.select("vid").distinct(), "vid", "left_semi").select("vid", F.col("from.doc_id").alias("want"), "from.th")
    pick = broadcast_if(work.stage(wanted), BROADCAST_ROWS)
    texts = base.join(pick, base["doc_id"].eqNullSafe(F.col("want")) & (base["th"] == pick["th"])).select("vid", "text")
    sets = texts.mapInArrow(_with_sets, "vid long, shingles binary")
    rows = sets.join(broadcast_if(candidates, BROADCAST_ROWS // 4), "vid")
    found = work.stage(rows.groupBy("key", "bx", "by").applyInArrow(lambda t: Bucket(t, threshold, least).links(), "vid long, links long, star long"))
    tidy(docs.sparkSession)
    degree = found.groupBy("vid").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("star").alias("a"), F.col("vid").alias("b")))
    work.made.append(roots)
    facts = nodes.select("node", "vid", "copies", "least").join(degree, "vid", "left").join(roots.select(F.col("v").alias("vid"), "root"), "vid", "left")
    facts = facts.select("node", F.coalesce("root", "vid").alias("comp"), "least", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    facts = work.stage(facts.filter("copies > 1 or links > 0"))
    # Where no row of a class has an id, its least node gives one.
    ids = facts.groupBy("comp").agg(F.coalesce(F.min("least"), F.xxhash64(F.min("node"))).alias("class_id"))
    out = stage(facts.join(ids, "comp").select("node", "comp", "class_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links")))
    rows = stage(signed.select("doc_id", "th", "node"))
    work.drop(signed)
    return rows, out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links.

    n_links is the number of other rows at Jaccard similarity `threshold` or more over distinct five-word shingles of the
    lower-cased text (words are [^\\x20\\x09-\\x0D]+; a text of one to four words is one shingle); class_id is the least
    doc_id among all rows connected by links. Null, empty and wordless texts have no links and are classes of their own.
    Rows are told apart by their texts, so rows that share a doc_id may be in several classes; a row with null doc_id counts
    as any other, and a class without any id takes one from its shingles' hash (null if it has none). Texts are whole
    however long, repeated rows give repeated results, other columns of docs are ignored, an empty table gives no rows.
    """
    rows, facts = _classes(docs, id_col, text_col, threshold)
    pairs = rows.join(broadcast_if(facts, BROADCAST_ROWS), "node", "left")
    own = F.coalesce("class_id", "doc_id", F.xxhash64("node"))
    return pairs.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs, with all its columns, of each class: that with the least doc_id (nulls last), then text hash.

    Rows alike in id and text are one document, of which any one stays. Rows whose text has no word all stay, as do rows
    that share a doc_id with a row of another class.
    """
    rows, facts = _classes(docs, id_col, text_col, threshold)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    members = rows.join(broadcast_if(facts.select("node", "comp"), BROADCAST_ROWS), "node").groupBy("comp", "doc_id", "th").agg(F.count(F.lit(1)).alias("times"))
    first = members.groupBy("comp").agg(F.min(key).alias("first"))
    judged = members.join(broadcast_if(first, BROADCAST_ROWS), "comp").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), (key == F.col("first")).alias("__first"), F.col("times").alias("__times"))
    # Documents in a class of their own aren't listed, and a first row that is there once isn't either.
    listed = stage(judged.filter("not __first or __times > 1"))
    keyed = docs.withColumns({"__own": F.col(id_col).cast("long"), "__text": _text_key(F.col(text_col).cast("string"))})
    same = lambda some: keyed["__own"].eqNullSafe(some["__id"]) & (keyed["__text"] == some["__th"])
    some = broadcast_if(listed.select("__id", "__th"), BROADCAST_ROWS)
    kept = keyed.join(some, same(some), "left_anti").select(*docs.columns)
    again = listed.filter("__first").select("__id", "__th")
    if again.isEmpty():
        return kept
    some = broadcast_if(again, BROADCAST_ROWS)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = keyed.join(some, same(some), "left_semi").groupBy("__own", "__text").agg(F.first(whole).alias("row"))
    return kept.unionByName(one.select("row.*"))
