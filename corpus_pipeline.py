"""From raw documents to packed sequences: language ID, line dedup, near duplicates, benchmark decontamination, packing.

Each stage works on what the one before it kept and returns the columns of documents; the last returns placed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stage
from strandlake.llm.decontaminate import decontaminate
from strandlake.llm.language_id import keep_identified
from strandlake.llm.line_dedup import dedup_lines
from strandlake.llm.ngram_jaccard import keep_one_of_each
from strandlake.llm.packing import pack
from strandlake.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected, or that have no letter, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated lines; documents that had lines and have none left go."""
    done = dedup_lines(docs).filter("n_lines = 0 or n_lines > n_removed")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all remaining documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: Language models, edit-distance joins and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
