"""k-mer sketch indexes and searches (IDX5, IDX6, J8, J11-J13, FN16).

A sketch is the list of selected k-mers of a sequence, written as dictionary ids. Ids start at 1 in order of first
occurrence (sequence, place); they are integers without an upper bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import HELD, check_k, held_parts, long_enough, minimizer_chunks, minimizers, mod_mer_chunks, mod_mers, selected_parts
from ..shared import stage
from ..sources.fasta import number_rows
from ..sources.tables import read_meta, write_meta

KMER_MODES = ("winnowing", "mod")
#: Queries with fewer selected k-mers are skipped.
MIN_SELECTED = 6
#: First occurrences that a task holds.
SEEN = 1 << 21
#: Words of a dictionary that are joined by broadcast; words (12 bytes each) that tasks look up where they sketch; beyond
#: both, sketches are shuffled to them.
BROADCAST_WORDS, HELD_WORDS = 400_000, 1 << 22
#: Ids of all queries, and candidates of a search, that are sent to every task; beyond them texts are shuffled.
BROADCAST_IDS, BROADCAST_STARTS = 400_000, 400_000
# Symbol counts that the reference's adaptive index chooses from.
ADAPTIVE_SIGMAS = (3, 4, 5, 6, 16, 32, 64, 128)


def adaptive_sigma(largest_value: int) -> int:
    """Least symbol count above the largest id; an error beyond 128, which only strict compatibility needs (IDX6)."""
    for s in ADAPTIVE_SIGMAS:
        if largest_value < s:
            return s
    raise ValueError(f"{largest_value} is beyond the largest adaptive index of {ADAPTIVE_SIGMAS[-1]} symbols")


def _chunks(k: int, mode: str, window: int, mod_exp: int):
    """(place, value) of the selected k-mers of each chunk, as a function of the sequence; the least letters that have any."""
    check_k(k)
    if mode not in KMER_MODES:
        raise ValueError(f"mode must be of {KMER_MODES}")
    if window < 1 or not 0 <= mod_exp <= 62:
        raise ValueError("window must be at least 1, mod_exp from 0 to 62")
    return (lambda seq: minimizer_chunks(seq, k, window), k + window - 1) if mode == "winnowing" else (lambda seq: mod_mer_chunks(seq, k, mod_exp), k)


def sketch(seqs: DataFrame, k: int = 1, mode: str = "winnowing", window: int = 1, mod_exp: int = 4) -> DataFrame:
    """seq_id, pos, value of the selected k-mers."""
    _chunks(k, mode, window, mod_exp)
    return minimizers(seqs, k, window) if mode == "winnowing" else mod_mers(seqs, k, mod_exp)


def _first_rows(parts):
    """Batches of value, seq_id, pos: of each value, its first occurrence in parts (seq_id, pos, value), as far as they are held.

    A task keeps the first occurrences that it has seen, and gives them away when they are more than SEEN, so that few rows
    are left to sort and to shuffle.
    """

    def first(parts):
        seq_id, pos, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, seq_id, value))
        order = order[np.r_[True, value[order][1:] != value[order][:-1]]] if len(order) else order
        return seq_id[order], pos[order], value[order]

    def rows(kept):
        for a in range(0, len(kept[0]), SEEN // 8):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + SEEN // 8]) for x in kept], names=["seq_id", "pos", "value"])

    kept, new, n = [], [], 0
    for part in parts:
        new.append(first([part]))
        n += len(new[-1][0])
        if n >= SEEN // 2:
            kept, new, n = first([*([kept] if kept else []), *new]), [], 0
            if len(kept[0]) >= SEEN:
                yield from rows(kept)
                kept = []
    if kept or new:
        yield from rows(first([*([kept] if kept else []), *new]))


_OCCURRENCE = "seq_id long, pos long, value long"


def first_seen(selected: DataFrame) -> DataFrame:
    """value, seq_id, pos: of each value, one row or few of a task, its first occurrence among them."""

    def run(batches):
        yield from _first_rows([batch.column(c).to_numpy() for c in ("seq_id", "pos", "value")] for batch in batches)

    return selected.select(*(F.col(c).cast("long").alias(c) for c in ("seq_id", "pos", "value"))).mapInArrow(run, _OCCURRENCE)


def first_selected(seqs: DataFrame, k: int = 1, mode: str = "winnowing", window: int = 1, mod_exp: int = 4) -> DataFrame:
    """first_seen() of a sketch, taken where the k-mers are selected: only first occurrences leave the task."""
    select, least = _chunks(k, mode, window, mod_exp)

    def run(batches):
        yield from _first_rows(held_parts(selected_parts(batches, select)))

    return long_enough(seqs, least).mapInArrow(run, _OCCURRENCE)


def dictionary(selected: DataFrame) -> DataFrame:
    """kmer_hash, kmer_id: first-seen order. Distinct k-mers are ranged and numbered by partition, not in one task."""
    return _numbered(first_seen(selected))


def sketch_dictionary(seqs: DataFrame, k: int = 1, mode: str = "winnowing", window: int = 1, mod_exp: int = 4) -> DataFrame:
    """dictionary() of the sketch of sequences."""
    return _numbered(first_selected(seqs, k, mode, window, mod_exp))


def _numbered(seen: DataFrame) -> DataFrame:
    first = seen.groupBy(F.col("value").alias("kmer_hash")).agg(F.min(F.struct("seq_id", "pos")).alias("at"))
    flat = first.select("kmer_hash", F.col("at.seq_id").alias("s"), F.col("at.pos").alias("p"))
    return number_rows(flat, "n", "s", "p", "kmer_hash").select("kmer_hash", (F.col("n") + 1).cast("int").alias("kmer_id"))


def id_texts(selected: DataFrame, words: DataFrame) -> DataFrame:
    """seq_id, kmer_ids in order of place."""
    words = F.broadcast(words) if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else words
    rows = selected.join(words, F.col("value") == F.col("kmer_hash"))
    return rows.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kmer_id"))).alias("x")).select("seq_id", F.col("x.kmer_id").alias("kmer_ids"))


def sketch_texts(seqs: DataFrame, words: DataFrame, k: int = 1, mode: str = "winnowing", window: int = 1, mod_exp: int = 4) -> DataFrame:
    """id_texts() of the sketch of sequences. Dictionaries of up to HELD_WORDS are sent to the tasks, so that no sketch is shuffled."""
    if words.limit(HELD_WORDS + 1).count() > HELD_WORDS:
        return id_texts(sketch(seqs, k, mode, window, mod_exp), words)
    select, least = _chunks(k, mode, window, mod_exp)
    table = words.select("kmer_hash", "kmer_id").toArrow()
    known, ids = (table.column(c).to_numpy() for c in ("kmer_hash", "kmer_id"))
    order = np.argsort(known)
    sent = seqs.sparkSession.sparkContext.broadcast((known[order], ids[order]))

    def run(batches):
        known, ids = sent.value
        rows, held, n = [], [], 0

        def out():
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held), pa.int32()))], names=["seq_id", "kmer_ids"])

        for batch in batches:
            seq_ids, texts = batch.column("seq_id").to_numpy(), batch.column("seq")
            for i, seq_id in enumerate(seq_ids):
                found = [value for _, value in select(texts[i].as_py())]
                value = np.concatenate(found) if found else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
                text = ids[at[known[at] == value]] if len(known) else ids[:0]
                if len(text):
                    rows.append(seq_id)
                    held.append(text)
                    n += len(text)
                if n >= HELD:
                    yield out()
                    rows, held, n = [], [], 0
        if rows:
            yield out()

    return long_enough(seqs, least).mapInArrow(run, "seq_id long, kmer_ids array<int>")


def build_kmer_index(refs: DataFrame, path: str, k: int = 1, mode: str = "winnowing", window: int = 1, mod_exp: int = 4) -> dict:
    """Write id texts, dictionary and description. Raises ValueError for an empty collection."""
    if refs.isEmpty():
        raise ValueError("the reference collection is empty")
    spark = refs.sparkSession
    words = sketch_dictionary(refs, k, mode, window, mod_exp)
    words.write.mode("overwrite").parquet(f"{path}/dictionary")
    words = spark.read.parquet(f"{path}/dictionary")
    sketch_texts(refs, words, k, mode, window, mod_exp).write.mode("overwrite").parquet(f"{path}/texts")
    facts = kmer_statistics(spark.read.parquet(f"{path}/texts"), words).first()
    meta = {"kind": "kmer", "mode": mode, "k": k, "window": window, "mod_exp": mod_exp, "largest_value": facts.distinct_kmers}
    write_meta(spark, path, **meta)
    return meta


def kmer_statistics(texts: DataFrame, words: DataFrame) -> DataFrame:
    """distinct_kmers, sketch_length (A2)."""
    total = texts.agg(F.coalesce(F.sum(F.size("kmer_ids")), F.lit(0)).cast("long").alias("sketch_length"))
    return words.agg(F.count(F.lit(1)).alias("distinct_kmers")).join(total)


def admit(queries: DataFrame, words: DataFrame, k: int, mode: str, window: int, mod_exp: int) -> DataFrame:
    """src_id, n_selected, known, kmer_ids of queries (src_id, seq): known is false if a selected k-mer isn't in the dictionary."""
    selected = sketch(queries.withColumnRenamed("src_id", "seq_id"), k, mode, window, mod_exp)
    found = selected.join(words, F.col("value") == F.col("kmer_hash"), "left")
    each = found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_selected"), F.bool_and(F.col("kmer_id").isNotNull()).alias("known"), F.array_sort(F.collect_list(F.struct("pos", "kmer_id"))).alias("x"))
    done = queries.select("src_id").join(each.withColumnRenamed("seq_id", "src_id"), "src_id", "left")
    return done.select("src_id", F.coalesce("n_selected", F.lit(0)).cast("long").alias("n_selected"), F.coalesce("known", F.lit(True)).alias("known"), F.coalesce(F.col("x.kmer_id"), F.array().cast("array<int>")).alias("kmer_ids"))


def admitted(rows: DataFrame, reverse: bool = True) -> DataFrame:
    """query_id (dense over surviving queries, strands interleaved), src_id, strand, kmer_ids; reversed lists stand for strand 1."""
    kept = number_rows(rows.filter(F.col("known") & (F.col("n_selected") >= MIN_SELECTED)), "n", "src_id")
    if not reverse:
        return kept.select(F.col("n").alias("query_id"), "src_id", F.lit(0).alias("strand"), "kmer_ids")
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col("kmer_ids").alias("ids")), F.struct(F.lit(1).alias("strand"), F.reverse("kmer_ids").alias("ids")))
    return kept.select("n", "src_id", F.explode(both).alias("x")).select((2 * F.col("n") + F.col("x.strand")).alias("query_id"), "src_id", "x.strand", F.col("x.ids").alias("kmer_ids"))


def admission_report(rows: DataFrame) -> DataFrame:
    """n_queries, unknown (dropped), skipped (too few), admitted, and total, least and greatest list length."""
    few = F.col("n_selected") < MIN_SELECTED
    ok = F.col("known") & ~few
    return rows.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(~F.col("known")).alias("unknown"), F.count_if(F.col("known") & few).alias("skipped"), F.count_if(ok).alias("admitted"),
        F.coalesce(F.sum(F.when(ok, F.col("n_selected"))), F.lit(0)).cast("long").alias("total_length"), F.min(F.when(ok, F.col("n_selected"))).alias("min_length"), F.max(F.when(ok, F.col("n_selected"))).alias("max_length"),
    )


def search_texts(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, src_id, seq_id, pos: occurrences of each id list in the texts, in sketch coordinates.

    The equi-join is on the query's rarest id, so that common k-mers don't multiply candidates. Few queries and candidates,
    by count, are broadcast: places and texts stream past them and are not shuffled.
    """
    queries = stage(queries)
    own = queries.select("query_id", "src_id", "kmer_ids", F.posexplode("kmer_ids").alias("offset", "kmer_id"))
    few = own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    near = F.broadcast if few else lambda df: df
    places = texts.select("seq_id", F.posexplode("kmer_ids").alias("p", "kmer_id"))
    counts = places.join(near(own.select("kmer_id").distinct()), "kmer_id", "left_semi").groupBy("kmer_id").agg(F.count(F.lit(1)).alias("n"))
    ids = own.join(counts, "kmer_id", "left")
    rare = ids.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "kmer_id")).alias("r")).select("query_id", "r.offset", "r.kmer_id")
    starts = stage(places.join(near(rare), "kmer_id").select("query_id", "seq_id", (F.col("p") - F.col("offset")).alias("at")).filter("at >= 0"))
    lists = texts.withColumnRenamed("kmer_ids", "ref")
    wide = lists.join(F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts, "seq_id").join(near(queries), "query_id")
    hit = F.slice("ref", F.col("at") + 1, F.size("kmer_ids")) == F.col("kmer_ids")
    return wide.filter(hit).select("query_id", "src_id", "seq_id", F.col("at").cast("long").alias("pos"))


def kmer_search(spark: SparkSession, path: str, queries: DataFrame, reverse: bool = True) -> DataFrame:
    """Hits of queries (src_id, seq) in a stored sketch index, with the sketch settings of the index."""
    meta = read_meta(spark, path, "kmer")
    words, texts = spark.read.parquet(f"{path}/dictionary"), spark.read.parquet(f"{path}/texts")
    rows = admit(queries, words, meta["k"], meta["mode"], meta["window"], meta["mod_exp"])
    own = admitted(rows, reverse)
    if own.isEmpty():
        raise ValueError("no query is left after admission")
    return search_texts(texts, own)
