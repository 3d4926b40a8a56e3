"""Searching a stream of reads in a static reference: a stateless join per micro-batch, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.search import expand_strands, search


def search_stream(reads: DataFrame, refs: DataFrame, path: str, checkpoint: str, errors: int = 0, metric: str = "edit", mode: str = "all", reverse: bool = True, available_now: bool = False) -> StreamingQuery:
    """Start a query that appends the hits of every micro-batch of reads (src_id, seq) to Parquet files at path.

    A batch that is run again after a failure overwrites its own folder, so hits aren't written twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        search(refs, expand_strands(rows, reverse), errors, metric, mode).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
