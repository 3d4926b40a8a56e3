"""The queries of this subpackage, with the parameters they run with in production, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import jaccard_join

    return jaccard_join(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(documents(spark, sf_dir))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_and_digest

    return store_and_digest(documents(spark, sf_dir), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir)).drop("spans")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(documents(spark, sf_dir))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_secret_scan, op3_language_id, op4_token_store, op5_quality_rules, op6_decontamination, op7_suffix_dedup, op8_best_fit_packing, op9_line_dedup, op10_license_scan, op11_phrase_collocations, op12_document_fingerprints, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.oracle_sql()
