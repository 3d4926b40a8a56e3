"""Index tables, hit sinks and run reports (SRC3-SRC7, SNK1, SNK2, SNK8)."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_stage, stage

FORMAT_VERSION = 1


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_meta(spark: SparkSession, path: str, **meta) -> None:
    row = {"format_version": FORMAT_VERSION, **meta}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta.parquet")


def read_meta(spark: SparkSession, path: str, *kinds: str) -> dict:
    """The index's description; errors if there is no index, or one of another kind or version."""
    if not path_exists(spark, path) or not path_exists(spark, f"{path}/_meta.parquet"):
        raise ValueError(f"no valid index at {path}")
    meta = spark.read.parquet(f"{path}/_meta.parquet").first().asDict()
    if meta["format_version"] != FORMAT_VERSION:
        raise ValueError(f"index {path} has format {meta['format_version']}, not {FORMAT_VERSION}")
    if kinds and meta["kind"] not in kinds:
        raise ValueError(f"index {path} is of kind {meta['kind']}, not {' or '.join(kinds)}")
    return meta


def hit_lines(hits: DataFrame) -> DataFrame:
    """The three-column text line of each hit (errors stay in the Parquet form)."""
    return hits.select(F.concat_ws(" ", "query_id", "seq_id", "pos").alias("value"))


def write_hits(hits: DataFrame, path: str, text: bool = True) -> None:
    order = [c for c in ("query_id", "errors", "seq_id", "pos") if c in hits.columns]
    ranged = hits.repartitionByRange(*order).sortWithinPartitions(*order)
    (hit_lines(ranged).write.mode("overwrite").text(path) if text else ranged.write.mode("overwrite").parquet(path))


def observed_stage(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """df as a table in the shared folder, and aggregates of it that the very job that writes it counted.

    The search runs once: neither the count nor the sampling of an ordered write computes it again, and no executor has to
    keep it cached.
    """
    seen = Observation(f"figures-{uuid.uuid4().hex}")
    out = stage(df.observe(seen, *[c.alias(k) for k, c in figures.items()]))
    return out, seen.get


def write_counted_hits(hits: DataFrame, path: str, text: bool = True) -> int:
    """write_hits() of a search that runs once; the number of hits (A5)."""
    staged, figures = observed_stage(hits, hits=F.count(F.lit(1)))
    try:
        write_hits(staged, path, text)
    finally:
        drop_stage(staged)
    return figures["hits"]


class Report:
    """Seconds by phase, queries per second and hit count of one run."""

    def __init__(self) -> None:
        self.phases: list[tuple[str, float]] = []

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases.append((name, time.perf_counter() - began))

    def total(self) -> float:
        return sum(s for _, s in self.phases)

    def frame(self, spark: SparkSession, queries: int = 0, hits: int = 0) -> DataFrame:
        total = self.total()
        rows = [*self.phases, ("total", total), ("queries per second", queries / total if total else 0.0), ("hits", float(hits))]
        return spark.createDataFrame(rows, "phase string, seconds double")
