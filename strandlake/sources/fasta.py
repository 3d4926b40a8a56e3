"""FASTA source and sink (SRC1, SRC2, SRC7, SNK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stage


def number_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds a contiguous 0-based number in the given order.

    Rows are range-partitioned and written with their place in their partition; the counts of the partitions, one number
    each, give the partitions' first numbers. No task sees all rows, and no row passes through Python.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(ranged.withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        firsts.append(total)
        total += counts.get(p, 0)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in firsts]), (part + 1).cast("int"))
    return rows.select(*df.columns, (first + place).alias(name))


def read_fasta(spark: SparkSession, path: str, seq_name: str = "seq_id") -> DataFrame:
    """(seq_id, id, seq): records in file order (files by name), numbered from 0; sequences over several lines are joined.

    A '>' inside a header doesn't split; Windows line ends are accepted. Raises ValueError if there is no record.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    # A place is a file, where its split begins, and a number within the split.
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__begin"), F.monotonically_increasing_id().alias("__at")]
    parts = raw.select("value", *place, body.alias("r")).filter(F.trim(F.regexp_replace("r", "[\r\n]", "")) != "")
    rec = parts.select("__file", "__begin", "__at", F.regexp_extract("r", "^([^\r\n]*)", 1).alias("id"), F.regexp_replace(F.regexp_replace("r", "^[^\r\n]*", ""), "[\r\n ]", "").alias("seq"))
    if rec.isEmpty():
        raise ValueError(f"{path} has no FASTA record")
    return number_rows(rec, seq_name, "__file", "__begin", "__at").select(seq_name, "id", "seq")


def fasta_text(df: DataFrame, line_length: int = 80) -> DataFrame:
    """One `value` per record: header and sequence, broken every line_length letters (0: never)."""
    seq = F.col("seq") if not line_length else F.regexp_replace("seq", f"(.{{{line_length}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), "id", F.lit("\n"), seq).alias("value"))


def write_fasta(df: DataFrame, path: str, line_length: int = 80) -> None:
    fasta_text(df, line_length).write.mode("overwrite").text(path)
