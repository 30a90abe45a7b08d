"""Candidates of studies as they arrive, and review decisions upon them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply `work` to each batch of whole studies and write its rows as Parquet under `to`, in a folder per batch, so that a batch
    run again after a failure replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_decisions(stream: DataFrame) -> DataFrame:
    """(branch_id, first, type): the last decision of a stream (branch_id, first, type, at) on each candidate, to be written in
    update or complete mode; of equally late ones the greatest type."""
    return stream.groupBy("branch_id", "first").agg(F.max(F.struct("at", "type")).alias("d")).select("branch_id", "first", "d.type")
