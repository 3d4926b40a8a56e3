"""Line dedup by a deletion-neighbourhood join: of lines within one edit of each other the earliest stays.

Two lines are within one edit if one is the other with a symbol deleted, or both become equal by deleting the symbol at
the same place. So every line emits, as hashed keys, itself and all its one-deletion variants, with and without the place,
and equal keys meet. Long lines have many variants, and most lines have no partner: a single edit leaves the first or the
second half of a line intact, so variants are emitted only by lines that share a half (with the length that the partner
must have) with another distinct line. That test loses no pair. Matches are verified by their edit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, PrefixHash, Stages, broadcast_if, code_points, mix64, pick_id_text, stage, text_slices, tidy

MAX_EDITS = 1
#: Rows of narrow tables (keys, line hashes, places) that may be broadcast, by count; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 400_000
LAST = (1 << 63) - 1

_OTHER_BASE = 0xC2B2AE3D27D4EB4F


def _lines(texts: list[str]):
    """(codes, start, end, row, number) of all lines with a word, and whether their row has the line before."""
    codes, off = code_points(texts)
    breaks = np.flatnonzero(codes == 10)
    ends = np.sort(np.concatenate((breaks, off[1:])))
    row_of_break = np.searchsorted(off, breaks, side="right") - 1
    per_row = np.bincount(row_of_break, minlength=len(texts)) + 1
    row = np.repeat(np.arange(len(texts)), per_row)
    # Within a row, a line begins after the break that ends the one before.
    first = np.cumsum(per_row) - per_row
    number = np.arange(len(row)) - np.repeat(first, per_row)
    start = np.where(number == 0, off[row], np.concatenate(([0], ends[:-1])) + 1)
    visible = np.concatenate(([0], np.cumsum(~np.isin(codes, (32, 9, 10, 11, 12, 13)))))
    keep = visible[ends] > visible[start]
    return codes, start[keep], ends[keep], row[keep], number[keep]


def _hash_pair(codes, start, end):
    a, b = PrefixHash(codes), PrefixHash(codes, _OTHER_BASE)
    n = (end - start).astype(U64)
    return a, mix64(a.ranges(start, end) + n), mix64(b.ranges(start, end) ^ n)


def _occurrences(batches):
    """The first occurrence of every line within its document, with hashes of its halves."""
    for batch in batches:
        for cut in text_slices(batch):
            texts = [t or "" for t in cut.column("text").to_pylist()]
            ids = cut.column("doc_id").fill_null(LAST).to_numpy()
            codes, start, end, row, number = _lines(texts)
            a, h1, h2 = _hash_pair(codes, start, end)
            order = np.lexsort((number, h2, h1, row))
            new = np.ones(len(order), bool)
            o, p = order[1:], order[:-1]
            new[1:] = (row[o] != row[p]) | (h1[o] != h1[p]) | (h2[o] != h2[p])
            k = np.sort(order[new])
            start, end, n = start[k], end[k], (end - start)[k]
            half, lower = start + n // 2, start + np.maximum(n - 1, 0) // 2
            # Of the halves that the longer line of a pair has, one is its own: the head if n is odd, the tail if it is even.
            odd = n % 2 == 1
            third = np.where(odd, a.ranges(np.minimum(lower + 1, end), end), a.ranges(start, lower))
            cols = [ids[row[k]], cut.column("th").to_numpy()[row[k]], number[k].astype(np.int32), h1[k].view(np.int64), h2[k].astype(np.uint32).view(np.int32), n.astype(np.int32)]
            cols += [mix64(v).astype(np.uint32).view(np.int32) for v in (a.ranges(start, half), a.ranges(half, end), third)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "th", "line", "h1", "h2", "n", "head", "tail", "other"])


OCCURRENCES = "doc_id long, th long, line int, h1 long, h2 int, n int, head int, tail int, other int"


def _half_keys(batches):
    """Keys that lines within one edit share: a half, with the shorter line's length."""
    for b in batches:
        get = lambda c: b.column(c).to_numpy().astype(np.uint32).astype(U64)
        n, head, tail, other = map(get, ("n", "head", "tail", "other"))
        odd = n % U64(2) == 1
        keys = []
        for part, length, side in ((head, n, 1), (tail, n, 2), (np.where(odd, head, other), n - U64(1), 1), (np.where(odd, other, tail), n - U64(1), 2)):
            keys.append(mix64(part ^ mix64(length * U64(4) + U64(side))).view(np.int64))
        h1 = b.column("h1").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(h1, 4))], names=["key", "h1"])


def _pick_lines(batches):
    """Texts of the wanted lines of each document."""
    for batch in batches:
        for cut in text_slices(batch):
            out = []
            for doc, text, wanted in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist(), cut.column("wanted").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                out += [(doc, w["line"], w["h1"], w["h2"], lines[w["line"]]) for w in wanted if w["line"] < len(lines)]
            # Rows that share a doc_id are told apart by the line's hash.
            codes, off = code_points([x[4] for x in out])
            _, h1, h2 = _hash_pair(codes, off[:-1], off[1:]) if out else (None, np.zeros(0, U64), np.zeros(0, U64))
            keep = [i for i, x in enumerate(out) if x[2] == int(h1[i].view(np.int64)) and x[3] == int(h2[i].astype(np.uint32).view(np.int32))]
            cols = list(zip(*[out[i] for i in keep], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "line", "h1", "h2", "text"])


def _variants(batches):
    """(key, exact, doc_id, line, h1): exact 1 is the line itself, 0 a deletion variant, 2 a variant with its place."""
    for batch in batches:
        for cut in text_slices(batch, max_bytes=1 << 16):
            codes, off = code_points(cut.column("text").to_pylist())
            p = PrefixHash(codes)
            start, end = off[:-1], off[1:]
            n = end - start
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(codes))
            gone = p.without(start[row], end[row], at, at + 1)
            # Deleting any symbol of a run gives one variant: the first place stands for the run.
            first = np.ones(len(codes), bool)
            first[1:] = codes[1:] != codes[:-1]
            first[start[n > 0]] = True
            v = np.flatnonzero(first)
            length = (n - 1).astype(U64)[row]
            whole = mix64(p.ranges(start, end) + n.astype(U64) * U64(0x9E3779B97F4A7C15))
            shorter = mix64(gone[v] + length[v] * U64(0x9E3779B97F4A7C15))
            placed = mix64(mix64(gone + length * U64(0x9E3779B97F4A7C15)) ^ (at - start[row] + 1).astype(U64) * U64(0x94D049BB133111EB))
            rows = np.concatenate((np.arange(len(n)), row[v], row))
            kind = np.concatenate((np.full(len(n), 1), np.full(len(v), 0), np.full(len(at), 2))).astype(np.int32)
            get = lambda c: cut.column(c).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((whole, shorter, placed)).view(np.int64)), pa.array(kind), get("doc_id"), get("line"), get("h1")], names=["key", "kind", "doc_id", "line", "h1"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), line, near: lines that repeat an earlier line, by their first place in the document.

    Repeats inside a document aren't listed: removing them needs that document alone.
    """
    base = pick_id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    spark, work = docs.sparkSession, Stages()
    occurrences = work.stage(base.mapInArrow(_occurrences, OCCURRENCES))
    firsts = [F.first(c).alias(c) for c in ("n", "head", "tail", "other")]
    places = [F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("doc_id"), F.min_by("line", "doc_id").alias("line")]
    distinct = work.stage(occurrences.groupBy("h1", "h2").agg(*places, *firsts))
    tidy(spark)
    keys = distinct.select("h1", "n", "head", "tail", "other").mapInArrow(_half_keys, "key long, h1 long")
    shared = work.stage(keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("key"))
    maybe = work.stage(keys.join(broadcast_if(shared, BROADCAST_ROWS), "key", "left_semi").select("h1").distinct())
    tidy(spark)
    wanted = work.stage(distinct.join(broadcast_if(maybe, BROADCAST_ROWS), "h1", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("wanted")))
    pick = F.broadcast(wanted) if maybe.count() <= BROADCAST_ROWS else wanted
    lines = work.stage(base.select("doc_id", "text").join(pick, "doc_id").mapInArrow(_pick_lines, "doc_id long, line int, h1 long, h2 int, text string").dropDuplicates(["h1", "h2"]))
    near = _verified(lines, work)
    tidy(spark)
    several = distinct.select("h1", "h2", "n_docs", F.col("doc_id").alias("d0")).join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    several = work.stage(several.select("h1", "h2", "d0", F.coalesce("near", F.lit(False)).alias("near"), "n_docs").filter("near or n_docs > 1"))
    repeats = _places(occurrences.select("h1", "h2", "doc_id", "th", "line"), several).filter("near or doc_id <> d0")
    out = stage(repeats.select("doc_id", "th", "line", (F.col("doc_id") == F.col("d0")).alias("near")))
    work.drop()
    return out


def _places(occurrences: DataFrame, several: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """occurrences with the row of several for their line, whichever lines a third of all documents may share.

    Up to limit lines are broadcast. Of more, those in more than a limit-th of all rows are at most limit lines, so they are
    broadcast, and their occurrences stay where they are; the others are shuffled, and none of them has more rows than that.
    """
    keys, lines = ["h1", "h2"], several.drop("n_docs")
    if several.count() <= limit:
        return occurrences.join(F.broadcast(lines), keys)
    common = F.col("n_docs") > occurrences.count() // limit
    hot = several.filter(common).drop("n_docs")
    rest = occurrences.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(several.filter(~common).drop("n_docs"), keys)
    return occurrences.join(F.broadcast(hot), keys).unionByName(rest)


def _verified(lines: DataFrame, work: Stages) -> DataFrame:
    """h1, h2 of lines whose edit distance to the earlier line they are linked to is within the bound."""
    links = work.stage(_links(lines, work))
    later = lines.select("h1", "h2", F.col("text").alias("later")).join(links, "h1")
    both = later.join(lines.select(F.col("h1").alias("first"), F.col("text").alias("earlier")), "first")
    return work.stage(both.filter(F.levenshtein("later", "earlier", MAX_EDITS) >= 0).select("h1", "h2").distinct())


def _links(lines: DataFrame, work: Stages) -> DataFrame:
    """h1, first: a line and an earlier one within one edit, by equal keys; one link per line."""
    # A line has two variants a symbol: lines are dealt out by themselves, not by the few files that hold them.
    spread = lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism, "h1")
    v = spread.mapInArrow(_variants, "key long, kind int, doc_id long, line int, h1 long")
    me = F.struct("doc_id", "line", "h1")
    low = v.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 2, me)).alias("placed"), F.min(F.when(F.col("kind") == 1, me)).alias("whole"), F.min(F.when(F.col("kind") == 0, me)).alias("shorter"),
        F.count_if(F.col("kind") == 2).alias("n2"),
    ).filter("n2 > 1 or (whole is not null and shorter is not null)")
    both = v.join(broadcast_if(work.stage(low), BROADCAST_ROWS), "key")
    rival = F.when(F.col("kind") == 2, F.col("placed")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("whole"))
    earlier = both.withColumn("rival", rival).filter((F.col("rival.doc_id") < F.col("doc_id")) | ((F.col("rival.doc_id") == F.col("doc_id")) & (F.col("rival.line") < F.col("line"))))
    return earlier.groupBy("h1").agg(F.min("rival").alias("r")).select("h1", F.col("r.h1").alias("first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the text rewritten, plus n_lines, n_removed and n_near.

    A line with a word, however short, goes if an earlier line (by doc_id, then place) of any document is equal to it or within
    one edit of it; lines are judged on the input, not on what is left. Blank lines stay. Null texts stay
    null, empty texts empty; null doc_ids come last; rows with the same doc_id and line are both first, so neither repeats
    the other; texts and lines are whole however long. Other columns of docs stay as they are, but for columns of docs named
    n_lines, n_removed or n_near, in whose place the counts stand. An empty table gives no rows.
    """
    repeats = find_repeats(docs, id_col, text_col)
    lists = repeats.groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("line", "near")).alias("__gone"))
    joined = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))
    same = (F.col("__key") == F.col("__doc")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__th"))
    joined = joined.join(lists, same, "left").drop("__doc", "__key", "__th")
    at = [f.name for f in docs.schema]
    schema = StructType(list(docs.schema.fields))
    for c, t in (("n_lines", "long"), ("n_removed", "long"), ("n_near", "long")):
        schema = schema.add(c, t) if c not in at else schema

    def rewrite(text: str, gone: list | None) -> tuple[str, int, int, int]:
        drop = {g["line"]: g["near"] for g in gone or ()}
        kept, seen, n, near = [], {}, 0, 0
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if not line.strip(" \t\n\x0b\x0c\r"):
                kept.append(line)
                continue
            n += 1
            if line in seen or i in drop:
                near += seen.setdefault(line, drop.get(i, False))
                continue
            seen[line] = False
            kept.append(line)
        return "\n".join(kept), n, len(lines) - len(kept), near

    def run(batches):
        names = ("n_lines", "n_removed", "n_near")
        for batch in batches:
            for cut in text_slices(batch, text_col):
                rows = [(None, 0, 0, 0) if t is None else rewrite(t, g) for t, g in zip(cut.column(text_col).to_pylist(), cut.column("__gone").to_pylist(), strict=True)]
                text, *counts = list(zip(*rows, strict=True)) if rows else [()] * 4
                new = {text_col: pa.array(text, pa.string())} | {c: pa.array(v, pa.int64()) for c, v in zip(names, counts, strict=True)}
                order = [*at, *[c for c in names if c not in at]]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else cut.column(c) for c in order], names=order)

    return joined.mapInArrow(run, schema)
