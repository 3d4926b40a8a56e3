"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as set on the session or context; where it is unset, a temporary folder if all runs on this machine.

    ValueError on a cluster: executors would not see a folder of the driver's.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: lineage ends in files every executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strandlake-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._strandlake_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_strandlake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Staged tables of one operator, to be deleted together once the last of them has been read."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def stage(self, df: DataFrame) -> DataFrame:
        self.made.append(stage(df))
        return self.made[-1]

    def drop(self, *more: DataFrame) -> None:
        for df in (*self.made, *more):
            drop_stage(df)
        self.made = []
