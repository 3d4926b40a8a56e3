"""Suffix arrays by prefix doubling, and the concatenated text that they are built on (IDX7, IDX8, W6, SNK4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import normalise, replace_unknown
from ..shared import stage
from ..sources.fasta import number_rows

START = 8
#: Letters of a chunk of the joined text.
CHUNK = 1 << 16


def _clean(refs: DataFrame, seed: int) -> DataFrame:
    return refs.select("seq_id", replace_unknown(normalise(F.col("seq"), "dna4"), "dna4", F.col("seq_id"), seed).alias("seq"))


def text_chunks(refs: DataFrame, seed: int = 0, size: int = CHUNK) -> DataFrame:
    """(start, text): the text of concat_text() in chunks of `size` letters, each by its place; no row holds the whole.

    Records find their places by the lengths before them: summed up per partition, one number each on the driver, and within
    a partition by a window.
    """
    ranged = _clean(refs, seed).repartitionByRange("seq_id").sortWithinPartitions("seq_id")
    rows = stage(ranged.withColumn("__m", F.monotonically_increasing_id()).withColumn("n", F.length("seq").cast("long")))
    part = F.shiftright("__m", 33)
    total, firsts = 0, {}
    for p, n in sorted(rows.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect()):
        firsts[p], total = total, total + n
    first = F.element_at(F.array(*[F.lit(firsts.get(p, 0)).cast("long") for p in range(max(firsts, default=0) + 1)]), (part + 1).cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(part).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.filter("n > 0").select((first + before).alias("at"), "n", "seq") if firsts else rows.select(F.lit(0).cast("long").alias("at"), "n", "seq").limit(0)
    end = rows.sparkSession.range(1).select(F.lit(total).cast("long").alias("at"), F.lit(1).cast("long").alias("n"), F.lit("$").alias("seq"))
    pieces = placed.union(end).select("at", "seq", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))).alias("c"))
    lo = F.greatest(F.col("c") * size - F.col("at"), F.lit(0))
    hi = (F.col("c") + 1) * size - F.col("at")
    pieces = pieces.select("c", (F.col("at") + lo).alias("at"), F.substring(F.col("seq").cast("binary"), (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string").alias("s"))
    whole = pieces.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("x"))
    return whole.select((F.col("c") * size).alias("start"), F.array_join("x.s", "").alias("text"))


def reverse_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of the reversed text."""
    total = chunks.agg(F.sum(F.length("text"))).first()[0] or 0
    return chunks.select((F.lit(total) - F.col("start") - F.length("text")).alias("start"), F.reverse("text").alias("text"))


def concat_text(refs: DataFrame, seed: int = 0) -> DataFrame:
    """One row `text`: all records in order without separators, unknown symbols drawn at random, one closing '$'.

    For collections that fit one row; text_chunks() has the same text in chunks.
    """
    clean = _clean(refs, seed)
    rows = clean.agg(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))).alias("x"))
    return rows.select(F.concat(F.array_join(F.col("x.seq"), ""), F.lit("$")).alias("text"))


def reverse_text(text: DataFrame) -> DataFrame:
    return text.select(F.reverse("text").alias("text"))


def suffix_array(text: DataFrame, column: str = "text") -> DataFrame:
    """(rank, pos) of all suffixes of a text in one row, or in chunks with their `start`, '$' before letters.

    A chunk's last places take the letters that they lack from the chunk after it, which has enough or is the last.
    Prefix doubling: ranks of the first 8 letters, then pairs of ranks 8, 16, 32, ... letters apart, until all differ. Each
    round is a join on the place and a ranking of distinct pairs; no task holds all suffixes.
    """
    own = text.select((F.col("start") if "start" in text.columns else F.lit(0)).cast("long").alias("start"), F.col(column).alias("t"), F.length(column).alias("n"))
    heads = own.select((F.col("start")).alias("end"), F.substring("t", 1, START - 1).alias("head"))
    own = own.join(heads, F.col("start") + F.col("n") == F.col("end"), "left") if "start" in text.columns else own.withColumn("head", F.lit(""))
    whole = F.concat("t", F.coalesce("head", F.lit(""))).cast("binary")
    places = own.select("start", whole.alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    rows = places.select((F.col("start") + F.col("at")).alias("pos"), F.substring("b", F.col("at") + 1, F.lit(START)).alias("key"))
    ranks = _rank(rows, "key")
    step = START
    while True:
        n, distinct = ranks.agg(F.count(F.lit(1)), F.count_distinct("rank")).first()
        if n == distinct:
            return number_rows(ranks, "order", "rank").select(F.col("order").alias("rank"), "pos")
        ahead = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, "pos", "left").select("pos", "rank", F.coalesce("next", F.lit(-1)).alias("next"))
        ranks = _rank(pairs, "rank", "next")
        step *= 2


def _rank(rows: DataFrame, *key: str) -> DataFrame:
    """pos, rank: the number of the row's key among distinct keys; lineage ends in a written table."""
    keys = number_rows(rows.select(*key).distinct(), "__n", *key)
    return stage(rows.join(keys, list(key)).select("pos", F.col("__n").alias("rank")))


def export_suffix_arrays(refs: DataFrame, base: str, seed: int = 0) -> None:
    """base.txt, base.sa, base.rev.txt and base.rev.sa: texts and their suffix arrays, numbers separated by spaces.

    Arrays are built from chunks of the text. Text and array are one line each by format, so a line holds the whole; rows
    are sorted in parallel and joined in order by chunk.
    """
    chunks = stage(text_chunks(refs, seed))
    for suffix, t in (("", chunks), (".rev", reverse_chunks(chunks))):
        whole = t.agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("x"))
        whole.select(F.array_join(F.col("x.text"), "").alias("text")).write.mode("overwrite").text(f"{base}{suffix}.txt")
        sa = suffix_array(t).repartitionByRange("rank").sortWithinPartitions("rank")
        chunks = sa.groupBy(F.floor(F.col("rank") / 1_000_000).alias("c")).agg(F.array_sort(F.collect_list(F.struct("rank", "pos"))).alias("x"))
        line = chunks.select("c", F.array_join(F.transform("x", lambda r: r["pos"].cast("string")), " ").alias("s")).agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("x"))
        line.select(F.array_join(F.col("x.s"), " ").alias("value")).write.mode("overwrite").text(f"{base}{suffix}.sa")
