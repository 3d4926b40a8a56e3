"""Persisted gram indexes and searches on them (IDX1-IDX4, IDX9, CMD1-CMD8).

An index holds, beside its sequences, three tables in buckets of their key's hash, a file each, sorted by key:

* `grams`: a row for each place that is held, by `cell`. A cell is a gram; grams with very many places have cells with a number after it.
* `counts`: how many places and cells the common grams have, by gram.
* `parts`: sequences in parts of PART letters that reach into the next, by part.

The keys that a search needs tell the buckets, so Spark opens the files of those alone; beyond LITERALS keys, a join with the
tables takes their buckets as they are. Neither way are stored rows shuffled.

Small collections hold every place. Larger ones hold, of each `window` grams side by side, the one with the least hash: a
stretch of gram_len + window - 1 letters that a query shares with a sequence has the same least gram in both, so one look-up
of that gram finds the stretch, and no hit is lost. Queries that are too short for such stretches are searched in the stored
sequences.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import COLLAPSE, letters, sigma
from ..functions.kmers import window_minima
from ..plans.planner import seed_regions, usable
from ..plans.schemes import Scheme
from ..shared import Stages
from ..sources.tables import read_meta, write_meta
from .search import METRICS, MODES, _seeds, _verify_windows, by_strata, cut_windows, expand_strands, grams, limit_queries, prepare, search, select_hits

#: Least and greatest gram length; in between it grows with the collection, so that a gram stands at few places of it.
MIN_GRAM, MAX_GRAM = 8, 24
KINDS = ("bi", "uni", "rbi")
#: Letters of a collection from which on one gram of WINDOW side by side is held; letters that are hashed at once.
LARGE, WINDOW, SLICE = 1 << 22, 16, 1 << 17
#: Letters of a gram that fit in a number whatever the alphabet; grams are shuffled and sorted as numbers, and stored as
#: letters, spelled in words of which there are so many at most.
PACKED, WORDS = 27, 1 << 10
#: Rows of a bucket that a large index aims at, the least that is worth one, and the buckets that even a small index has by then.
BUCKET_ROWS, LEAST_ROWS, BUCKETS = 4_000_000, 2_000, 256
#: Places of a gram that share a cell, and of a gram that is counted: the others have hardly any.
CELL, COMMON = 1_000_000, 4
#: Classes of grams by hash whose places are counted, to find those that can have a gram with more than CELL places.
BINS = 1 << 16
#: Letters of a part, and how far it reaches into the next; longer queries are searched in the stored sequences.
PART, REACH = 1 << 16, 1 << 12
#: Keys that are looked up by their buckets; more are joined with all of them, sent to every task as far as BROADCAST.
LITERALS, BROADCAST = 2_000, 50_000
#: Grams that are counted in the stored sequences by every task for itself; more are joined with all places.
COUNTED = 400_000
_TABLES = {"grams": ("cell", "cell binary, seq_id bigint, p bigint"), "counts": ("gram", "gram binary, n bigint, cells int"), "parts": ("part", "part bigint, seq_id bigint, base bigint, seq string")}


def statistics(refs: DataFrame, alphabet: str = "dna5") -> DataFrame:
    """n_seqs, total_size, sigma (IDX9, A1)."""
    return refs.agg(F.count(F.lit(1)).alias("n_seqs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("total_size")).withColumn("sigma", F.lit(sigma(alphabet)))


def gram_length(total_size: int, alphabet: str) -> int:
    """Letters of a gram that random text of this size has about once."""
    symbols = min(len(letters(alphabet).replace("N", "")), 4)
    n, reach = MIN_GRAM, symbols**MIN_GRAM
    while reach < total_size and n < MAX_GRAM:
        n, reach = n + 1, reach * symbols
    return n


def window_length(total_size: int) -> int:
    return WINDOW if total_size >= LARGE else 1


def _runs(values: np.ndarray, g: int, factor: int) -> np.ndarray:
    """The polynomial in `factor` of each g values side by side, from runs of 1, 2, 4, ... values."""
    run, size, out, done = values.astype(np.uint64), 1, None, 0
    while True:
        if g & size:
            out = run if out is None else out[: len(run) - done] * np.uint64(factor) + run[done:] if done else out
            done += size
        if 2 * size > g:
            break
        run = run[:-size] * np.uint64(factor) + run[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    return out[: len(values) - g + 1]


def gram_hashes(letters: np.ndarray, g: int) -> np.ndarray:
    """A 64-bit hash of each gram of g letters: polynomials of runs of 1, 2, 4, ... letters, joined to g, then mixed."""
    out = _runs(letters.astype(np.uint64) + np.uint64(1), g, 0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def digits_of(alphabet: str) -> str:
    """Letters in byte order: numbers of grams, whose digits they are, are in the order of the grams."""
    return "".join(sorted(letters(alphabet)))


def gram_values(letters: np.ndarray, digits: str) -> np.ndarray:
    value = np.zeros(256, np.uint8)
    value[list(digits.encode())] = range(len(digits))
    return value[letters]


def gram_numbers(letters: np.ndarray, at: np.ndarray, g: int, digits: str) -> np.ndarray:
    """The numbers of the grams at some places."""
    values, out = gram_values(letters, digits), np.zeros(len(at), np.int64)
    for j in range(g):
        out = out * len(digits) + values[at + j]
    return out


def spell(number: str, g: int, digits: str) -> Column:
    """The letters of a column of grams' numbers, from words of some letters."""
    parts, left, most = [], g, max(n for n in range(1, PACKED) if len(digits) ** n <= WORDS)
    while left:
        n = left % most or most
        left -= n
        words = F.split(F.lit(" ".join("".join(w) for w in product(digits, repeat=n))), " ")
        parts.append(F.get(words, F.expr(f"cast(({number} div {len(digits) ** left}L) % {len(digits) ** n}L as int)")))
    return F.concat(*parts).cast("binary")


def least_grams(seq: bytes, g: int, window: int) -> np.ndarray:
    """For each `window` grams side by side, the place of the one with the least hash, the leftmost of equals."""
    n = max(len(seq) - g - window + 2, 0)
    if window == 1:
        return np.arange(n)
    letters, out = np.frombuffer(seq, np.uint8), []
    for a in range(0, n, SLICE):
        end = min(a + SLICE, n)
        out.append(window_minima(gram_hashes(letters[a : end + g + window - 2], g), window)[1] + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def least_places(letters: np.ndarray, lengths: np.ndarray, g: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences that lie one after the other: the number of the sequence, the place there and among all letters of each least gram."""
    if len(lengths) == 1:
        at = np.unique(least_grams(letters.tobytes(), g, window)).astype(np.int64)
        return np.zeros(len(at), np.int64), at, at
    return _least_of(gram_hashes(letters, g), lengths, g, window)


def _least_of(hashes: np.ndarray, lengths: np.ndarray, g: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """least_places() of letters whose grams have these hashes."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at = window_minima(hashes, window)[1] if len(hashes) >= window else np.zeros(0, np.int64)
    at = at[_inside(ends, lengths, g + window - 1)]
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    of = np.repeat(np.arange(len(lengths)), lengths)[at]
    return of, at - (ends - lengths)[of], at


def _inside(ends: np.ndarray, lengths: np.ndarray, span: int) -> np.ndarray:
    """Of sequences that lie one after the other: whether `span` letters from a place on are of one sequence, for each place that has so many."""
    inside = np.ones(max(int(ends[-1]) - span + 1, 0), bool)
    over = np.maximum(ends[:, None] - np.arange(1, span), (ends - lengths)[:, None])[lengths > 0].ravel()
    inside[over[over < len(inside)]] = False
    return inside


def _slices(batches, span: int):
    """(numbers, letters, lengths, base) of Arrow batches of seq_id and b: sequences that lie one after the other, of about SLICE letters in all.

    Of a longer sequence, slices of its own, which begin at `base` and overlap by span - 1 letters.
    """
    for batch in batches:
        ids, seqs = batch.column("seq_id").to_numpy(), batch.column("b").cast(pa.binary())
        ends = np.frombuffer(seqs.buffers()[1], np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
        every, done = np.frombuffer(seqs.buffers()[2], np.uint8), 0
        while done < len(ids):
            first = done
            done = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
            own = every[ends[first] : ends[done]]
            if done - first > 1 or len(own) <= SLICE:
                yield ids[first:done], own, np.diff(ends[first : done + 1]), 0
                continue
            for a in range(0, len(own) - span + 1, SLICE):
                piece = own[a : a + SLICE + span - 1]
                yield ids[first:done], piece, np.array([len(piece)]), a


def _least(slices, g: int, window: int):
    """Of each slice: its letters, and of each least gram the sequence's number, the places there and in the slice, and the hash."""
    last = None
    for ids, own, lengths, base in slices:
        hashes = gram_hashes(own, g)
        of, places, at = _least_of(hashes, lengths, g, window)
        places = places + base
        if base and len(at) and (ids[0], places[0]) == last:
            of, places, at = of[1:], places[1:], at[1:]
        if len(at):
            last = ids[-1], places[-1]
        yield own, ids[of].astype(np.int64), places, at, hashes[at]


def _in_slices(refs: DataFrame, span: int, run, schema: str) -> DataFrame:
    """run(_slices) over the sequences of at least `span` letters."""
    rows = refs.filter(F.length("seq") >= span).select(F.col("seq_id").cast("long").alias("seq_id"), F.col("seq").cast("binary").alias("b"))
    return rows.mapInArrow(lambda batches: run(_slices(batches, span)), schema)


def held_grams(refs: DataFrame, g: int, window: int, digits: str = "", bins: tuple[int, ...] = ()) -> DataFrame:
    """gram, seq_id, p of the places that an index holds; with `digits` grams are numbers, with `bins` only places of these bins are given."""
    if window == 1 and not digits and not bins:
        return grams(refs, g).select("gram", "seq_id", F.col("p").cast("long").alias("p"))

    def run(slices):
        for own, ids, places, at, hashes in _least(slices, g, window):
            if bins:
                some = np.isin(_bins(hashes), bins)
                ids, places, at = ids[some], places[some], at[some]
            if digits:
                gram = pa.array(gram_numbers(own, at, g, digits))
            else:
                flat = np.lib.stride_tricks.sliding_window_view(own, g)[at] if len(at) else own[:0]
                gram = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, flat.size + 1, g, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([gram, pa.array(ids), pa.array(places)], names=["gram", "seq_id", "p"])

    return _in_slices(refs, g + window - 1, run, f"gram {'long' if digits else 'binary'}, seq_id long, p long")


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def hot_grams(refs: DataFrame, g: int, window: int, digits: str = "") -> DataFrame | None:
    """gram, cells of the grams with more than CELL held places, if there are any.

    Such a gram's bin has as many places. Bins are counted in the tasks that find the places, which give none of them away.
    """

    def run(slices):
        n = np.zeros(BINS, np.int64)
        for *_, hashes in _least(slices, g, window):
            n += np.bincount(_bins(hashes), minlength=BINS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bin", "n"])

    full = _in_slices(refs, g + window - 1, run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).filter(F.col("n") > CELL)
    bins = tuple(r.bin for r in full.select("bin").collect())
    if not bins:
        return None
    counted = held_grams(refs, g, window, digits, bins).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    return counted.select("gram", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))


def bucket_count(rows: int) -> int:
    return max(1, min(BUCKETS, rows // LEAST_ROWS), -(-rows // BUCKET_ROWS))


def _whole(spark: SparkSession, path: str) -> str:
    """The path as the file system has it: tables would take a relative one from the warehouse."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _write_buckets(rows: DataFrame, path: str, name: str, buckets: int) -> None:
    """A file for each bucket of the table's key, of rows that are dealt by it and sorted. Only a passing entry is made in the session's catalog.

    The writer would sort by the hash of the key first, and reckon it anew for each comparison; with leave to write several
    buckets at once it takes the rows as they come.
    """
    table = f"strandlake_{uuid.uuid4().hex}"
    spark, key = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "8")
    try:
        rows.write.mode("overwrite").option("compression", "zstd").option("path", f"{_whole(spark, path)}/{name}").bucketBy(buckets, _TABLES[name][0]).saveAsTable(table)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.repartition(buckets, key).sortWithinPartitions(key)


def stored(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """A table of an index, with its buckets known to the planner."""
    key, schema = _TABLES[name]
    table = f"strandlake_{uuid.uuid4().hex}"
    quoted = _whole(spark, path).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{quoted}/{name}'")
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def _cell(gram: Column, number: Column) -> Column:
    return F.concat(gram, F.encode(F.lpad(number.cast("string"), 10, "0"), "utf-8"))


def build_index(refs: DataFrame, path: str, alphabet: str = "dna5", kind: str | None = None, ignore_unknown: bool = False, gram_len: int | None = None, seed: int = 0, window: int | None = None) -> dict:
    """Write sequences, the tables of the index and a description. Raises ValueError for an empty collection.

    The length of grams, and of how many side by side one is held, follow from the collection's size, unless they are given.
    """
    letters(alphabet)
    kind = kind or ("rbi" if alphabet.startswith("dr_") else "bi")
    if kind not in KINDS:
        raise ValueError(f"kind must be of {KINDS}")
    if refs.isEmpty():
        raise ValueError("the reference collection is empty")
    spark = refs.sparkSession
    ready = prepare(refs, alphabet, ignore_unknown, seed)
    ready.select(F.col("seq_id").cast("long").alias("seq_id"), "id" if "id" in refs.columns else F.lit(None).cast("string").alias("id"), "seq").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/sequences")
    ready = spark.read.parquet(f"{path}/sequences")
    facts = statistics(ready, alphabet).first()
    gram_len = gram_len or gram_length(facts.total_size, alphabet)
    window = window or window_length(facts.total_size)
    buckets = bucket_count(2 * facts.total_size // (window + 1))
    digits = digits_of(alphabet) if gram_len <= PACKED else ""
    places = held_grams(ready, gram_len, window, digits)
    hot = hot_grams(ready, gram_len, window, digits) if facts.total_size > CELL else None
    cell, order = spell("gram", gram_len, digits) if digits else F.col("gram"), ["gram"]
    if hot is not None:
        # There are at most as many as CELL goes into all places.
        places = places.join(F.broadcast(hot), "gram", "left").withColumn("number", F.pmod(F.xxhash64("seq_id", "p"), F.col("cells")))
        cell, order = F.when(F.col("number").isNotNull(), _cell(cell, F.col("number"))).otherwise(cell), ["gram", "number"]
    dealt = places.select(*order, "seq_id", "p", F.pmod(F.hash(cell), F.lit(buckets)).alias("bucket")).repartitionById(buckets, F.col("bucket"))
    _write_buckets(dealt.sortWithinPartitions(*order).select(cell.alias("cell"), "seq_id", "p"), path, "grams", buckets)
    # Cells are counted where they lie; only those of hot grams are added up.
    lying = stored(spark, path, "grams", buckets).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= COMMON) | (F.length("cell") > gram_len))
    counts = lying.groupBy(F.substring("cell", 1, gram_len).alias("gram")).agg(F.sum("n").alias("n"))
    _write_buckets(_dealt(counts.withColumn("cells", F.when(F.col("n") > CELL, F.ceil(F.col("n") / CELL)).otherwise(1).cast("int")), "gram", buckets), path, "counts", buckets)
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(PART))
    cut = ready.select("seq_id", F.col("seq").cast("binary").alias("b"), F.posexplode(starts).alias("k", "base"))
    parts = cut.select(_part(F.col("seq_id"), F.col("k")).alias("part"), "seq_id", F.col("base").cast("long").alias("base"), F.substring("b", F.col("base") + 1, F.lit(PART + REACH)).cast("string").alias("seq"))
    _write_buckets(_dealt(parts, "part", buckets), path, "parts", buckets)
    meta = {"kind": kind, "alphabet": alphabet, "gram_len": gram_len, "n_seqs": facts.n_seqs, "total_size": facts.total_size, "sigma": facts.sigma, "buckets": buckets, "window": window}
    write_meta(spark, path, **meta)
    return meta


def share_index(spark: SparkSession, path: str, other: str, alphabet: str, kind: str) -> dict:
    """Write another description of an index's tables: of another kind, or of another alphabet with the letters of its sequences.

    The tables of an index follow from its letters alone. A symbol that the alphabet lacks raises an error, as in a build.
    """
    meta = read_meta(spark, other, *KINDS)
    if kind not in KINDS or (alphabet in COLLAPSE) != (meta["alphabet"] in COLLAPSE):
        raise ValueError(f"kind must be of {KINDS}, and the alphabet must have the letters of {meta['alphabet']}")
    tables = tables_of(meta, other)
    lacks = sorted(set(letters(meta["alphabet"])) - set(letters(alphabet)))
    if lacks:
        # Only sequences with such a symbol are looked at more closely, to name it and its place.
        bad = spark.read.parquet(f"{tables}/sequences").filter(reduce(Column.__or__, [F.col("seq").contains(x) for x in lacks]))
        prepare(bad.withColumn("id", F.coalesce("id", F.col("seq_id").cast("string"))), alphabet).filter(F.length("seq") >= 0).count()
    meta = {k: v for k, v in meta.items() if k != "format_version"} | {"kind": kind, "alphabet": alphabet, "sigma": sigma(alphabet), "tables": _whole(spark, tables)}
    write_meta(spark, path, **meta)
    return meta


def tables_of(meta: dict, path: str) -> str:
    """Where the tables of the index at the path are."""
    return meta.get("tables") or path


def _part(seq_id: Column, k: Column) -> Column:
    return F.xxhash64(seq_id.cast("long"), k.cast("int"))


def few(keys: DataFrame, column: str) -> list | None:
    """The distinct keys, if there are at most LITERALS."""
    got = keys.select(column).distinct().limit(LITERALS + 1).collect()
    return [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in got] if len(got) <= LITERALS else None


def look_up(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows joined with a stored table on its key; few keys open their buckets only."""
    keys = few(rows, key)
    if keys is not None:
        return table.filter(F.col(key).isin(keys)).join(F.broadcast(rows), key) if rows.limit(BROADCAST + 1).count() <= BROADCAST else table.filter(F.col(key).isin(keys)).join(rows, key)
    return table.join(F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows, key)


def cheapest_seeds(counts: np.ndarray, seeds: int, g: int) -> list[int]:
    """Offsets of `seeds` disjoint grams of length g with the fewest places in all, the first such ones; counts: places by offset."""
    n = len(counts)
    best, steps = np.zeros(n + g, np.int64), []
    for _ in range(seeds):
        # here[i]: the cost of this seed at i and of those before it, which end by i; low: the least over places up to i.
        here = counts + best[:n]
        low = np.minimum.accumulate(here)
        steps.append((here, low))
        best = np.concatenate((np.full(g, np.iinfo(np.int64).max // 4), low))
    out, upto = [], n
    for here, low in reversed(steps):
        at = int(np.flatnonzero(here[:upto] == low[upto - 1])[0])
        out.append(at)
        upto = at - g + 1
    return out[::-1]


def window_of(meta: dict) -> int:
    return meta.get("window") or 1


def stored_counts(spark: SparkSession, path: str, meta: dict, wanted: DataFrame) -> DataFrame:
    """gram, n, cells of those of the wanted grams that are common among the places that the index holds."""
    return look_up(stored(spark, path, "counts", meta["buckets"]), wanted.select("gram").distinct(), "gram")


def sequence_counts(spark: SparkSession, path: str, meta: dict, wanted: DataFrame) -> DataFrame:
    """gram, n, cells of those of the wanted grams that are common among all places of the stored sequences, held or not."""
    if window_of(meta) == 1:
        return stored_counts(spark, path, meta, wanted)
    keys, g = wanted.select("gram").distinct(), meta["gram_len"]
    refs = spark.read.parquet(f"{path}/sequences")
    if g <= PACKED and keys.limit(COUNTED + 1).count() <= COUNTED:
        counted = _counts_of(refs, keys, g, digits_of(meta["alphabet"]))
    else:
        counted = grams(refs, g).select("gram").join(keys, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= COMMON).withColumn("cells", F.lit(1))


def _counts_of(refs: DataFrame, keys: DataFrame, g: int, digits: str) -> DataFrame:
    """gram, n of these grams of g letters; each task counts them in its sequences, whose places are neither rows nor shuffled."""
    flat = np.frombuffer(b"".join(bytes(r.gram) for r in keys.collect()), np.uint8)
    known = np.unique(gram_numbers(flat, np.arange(0, len(flat), g), g, digits))
    sent = refs.sparkSession.sparkContext.broadcast(known)
    mark = lambda numbers: ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def run(slices):
        known = sent.value
        n, marked = np.zeros(len(known), np.int64), np.zeros(1 << 20, bool)
        marked[mark(known.astype(np.uint64))] = True
        for _, own, lengths, _ in slices:
            numbers = _runs(gram_values(own, digits), g, len(digits))
            some = numbers[marked[mark(numbers)] & _inside(np.cumsum(lengths, dtype=np.int64), lengths, g)].astype(np.int64)
            at = np.searchsorted(known, some)
            at = at[known[np.minimum(at, len(known) - 1)] == some] if len(known) else at[:0]
            n += np.bincount(at, minlength=len(known))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(n[some])], names=["number", "n"])

    counted = _in_slices(refs, g, run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    return counted.select(spell("number", g, digits).alias("gram"), "n")


def frequent_seeds(spark: SparkSession, path: str, meta: dict, queries: DataFrame, errors: int, every: bool = False) -> DataFrame:
    """query_id, offset, gram, cells, n: the least grams of errors + 1 disjoint stretches of each query with the fewest places; grams that aren't common count as one.

    Places are those that the index holds; with `every`, all of the stored sequences, and each gram is a stretch.
    """
    g, window = meta["gram_len"], 1 if every else window_of(meta)

    def least(seqs: pd.Series) -> pd.Series:
        return pd.Series([np.unique(least_grams(s.encode(), g, window)) for s in seqs])

    wanted = queries.select("query_id", F.col("seq").cast("binary").alias("b"), F.explode(F.pandas_udf(least, "array<int>")("seq")).alias("offset"))
    wanted = wanted.select("query_id", "offset", F.substring("b", F.col("offset") + 1, F.lit(g)).alias("gram"))
    counted = wanted.join((sequence_counts if every else stored_counts)(spark, path, meta, wanted), "gram").groupBy("query_id").agg(F.collect_list(F.struct("offset", "n", "cells")).alias("x"))

    def pick(seqs: pd.Series, offsets: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for s, at, n in zip(seqs, offsets, numbers, strict=True):
            counts = np.ones(len(s) - g + 1, np.int64)
            if at is not None:
                counts[at] = n
            of = least_grams(s.encode(), g, window)
            out.append(of[cheapest_seeds(counts[of], errors + 1, g + window - 1)])
        return pd.Series(out)

    chosen = F.pandas_udf(pick, "array<int>")(F.col("seq"), F.col("x.offset"), F.col("x.n"))
    of = F.map_from_entries(F.transform("x", lambda e: F.struct(e["offset"], F.struct(e["cells"].alias("cells"), e["n"].alias("n")))))
    rows = queries.join(counted, "query_id", "left").withColumn("of", of).select("query_id", F.col("seq").cast("binary").alias("b"), "of", F.explode(chosen).alias("offset"))
    figure = lambda name: F.coalesce(F.try_element_at("of", F.col("offset"))[name], F.lit(1)).alias(name)
    return rows.select("query_id", "offset", F.substring("b", F.col("offset") + 1, F.lit(g)).alias("gram"), figure("cells"), figure("n"))


def _region_seeds(queries: DataFrame, scheme: Scheme, g: int, window: int) -> DataFrame:
    """query_id, offset, gram: the least gram of the first stretch of each region that a scheme wants free of errors."""
    regions, parts = seed_regions(scheme)
    rows = _seeds(queries, regions, parts, (g + window - 1,))

    def least(stretches: pd.Series) -> pd.Series:
        return pd.Series([int(least_grams(bytes(s), g, window)[0]) for s in stretches], dtype="int32")

    at = F.pandas_udf(least, "int")("gram") if window > 1 else F.lit(0)
    return rows.select("query_id", "offset", "gram", at.alias("at")).select("query_id", (F.col("offset") + F.col("at")).alias("offset"), F.substring("gram", F.col("at") + 1, F.lit(g)).alias("gram"))


def probe_cells(spark: SparkSession, path: str, meta: dict, queries: DataFrame, errors: int, scheme: Scheme | None = None) -> DataFrame:
    """query_id, offset, cell: what a search for the queries looks up."""
    if scheme:
        seeds = _region_seeds(queries, scheme, meta["gram_len"], window_of(meta))
        seeds = seeds.join(stored_counts(spark, path, meta, seeds).drop("n"), "gram", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    else:
        seeds = frequent_seeds(spark, path, meta, queries, errors).drop("n")
    numbers = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("number")
    split = seeds.select("query_id", "offset", "gram", "cells", numbers)
    return split.select("query_id", "offset", F.when(F.col("cells") > 1, _cell(F.col("gram"), F.col("number"))).otherwise(F.col("gram")).alias("cell"))


def buckets_read(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """cells, buckets, of_buckets: how much of the grams a search for these cells opens."""
    n = read_meta(spark, path, *KINDS)["buckets"]
    return cells.select("cell").distinct().agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(F.pmod(F.hash("cell"), F.lit(n))).alias("buckets")).select("cells", F.when(F.col("cells") > LITERALS, n).otherwise(F.col("buckets")).cast("long").alias("buckets"), F.lit(n).cast("long").alias("of_buckets"))


def _find(spark: SparkSession, path: str, meta: dict, queries: DataFrame, errors: int, metric: str, scheme: Scheme | None, stages: Stages) -> DataFrame:
    """All hits of queries that are long enough to have seeds."""
    probes = stages.stage(probe_cells(spark, path, meta, queries, errors, scheme))
    shift = errors if metric == "edit" else 0
    found = look_up(stored(spark, path, "grams", meta["buckets"]), probes, "cell").select("query_id", F.col("seq_id").alias("of"), (F.col("p") - F.col("offset")).alias("place")).filter(F.col("place") >= -shift).distinct()
    # The part with the place has all starts but those before it, which the part before has.
    base = lambda at: F.floor(F.greatest(at, F.lit(0).cast("long")) / PART)
    found = found.select("query_id", "of", "place", F.explode(F.array_distinct(F.array(base(F.col("place") - shift), base(F.col("place"))))).alias("k"))
    found = stages.stage(found.select("query_id", "of", "place", (F.col("k") * PART).alias("from"), _part(F.col("of"), F.col("k")).alias("part")))
    near = look_up(stored(spark, path, "parts", meta["buckets"]), found, "part").filter((F.col("seq_id") == F.col("of")) & (F.col("base") == F.col("from")))
    wide = near.select("query_id", "seq_id", "base", (F.col("place") - F.col("base")).cast("int").alias("at"), F.col("seq").cast("binary").alias("b")).join(queries.select("query_id", "seq"), "query_id")
    windows = cut_windows(wide, errors, metric)
    return _verify_windows(windows, errors, metric).groupBy("query_id", "seq_id", "pos").agg(F.min("errors").alias("errors"))


def search_index(spark: SparkSession, path: str, queries: DataFrame, errors: int = 0, metric: str = "edit", mode: str = "all", max_hits: int = 0, reverse: bool = True, limit: int | None = None, ignore_unknown: bool = False, scheme: Scheme | None = None) -> DataFrame:
    """Hits of queries (src_id, seq) in a stored index. Uni indexes answer exact searches only; rbi ones take no reverse.

    Seeds are of errors + 1 disjoint stretches of a query with the fewest stored places, or of a scheme that covers all
    errors; only the buckets that hold them are read, and only the parts of sequences with candidates. Best hits are sought
    by rising errors, each time for the queries that have none yet. Queries shorter than their seeds' grams, and very long
    ones, are searched in the stored sequences. Hits are the same with any scheme.
    """
    if metric not in METRICS or mode not in MODES or errors < 0 or max_hits < 0:
        raise ValueError(f"metric must be of {METRICS}, mode of {MODES}; errors and max_hits must not be negative")
    meta = read_meta(spark, path, *KINDS)
    if meta["kind"] == "uni" and errors:
        raise ValueError("a uni index answers exact searches only")
    if queries.isEmpty():
        raise ValueError("the query collection is empty")
    path, collapsed = tables_of(meta, path), meta["alphabet"].startswith("dr_")
    ready = prepare(queries.withColumn("src_id", F.col("src_id").cast("long")), meta["alphabet"], ignore_unknown)
    metric = "edit" if collapsed else metric
    stages = Stages()
    own = stages.stage(limit_queries(expand_strands(ready, reverse and not collapsed), limit).select("query_id", "seq"))
    # A sequence as the file has it would be copied for each of its places; one that was computed is not.
    refs = spark.read.parquet(f"{path}/sequences").withColumn("seq", F.concat("seq", F.lit("")))

    def find(left: DataFrame, k: int) -> DataFrame:
        plan = scheme if scheme and k and usable(scheme, k) else None
        parts = max(len(plan[0].pi) if plan else 0, k + 1)
        fits = (F.length("seq") >= (meta["gram_len"] + window_of(meta) - 1) * parts) & (F.length("seq") + 3 * k <= REACH)
        used = "hamming" if k == 0 else metric
        out = []
        if not (long := left.filter(fits)).isEmpty():
            out.append(_find(spark, path, meta, long, k, used, plan, stages))
        if not (rest := left.filter(~fits)).isEmpty():
            out.append(search(refs, rest, k, used))
        return reduce(DataFrame.union, out)

    if own.isEmpty():
        return spark.createDataFrame([], "query_id long, seq_id long, pos long, errors int")
    hits = by_strata(own, errors, find) if mode == "best" else find(own, errors)
    return select_hits(hits, "all", max_hits)


def gram_counts(refs: DataFrame, g: int) -> DataFrame:
    """gram, n: how often each gram occurs."""
    return grams(refs, g).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).select(F.col("gram").cast("string").alias("gram"), "n")
