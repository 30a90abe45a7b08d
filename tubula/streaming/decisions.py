"""Review decisions as a stream: a state per candidate that ends, a table that is upserted, and candidates as they stand."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect

LATEST = "branch_id long, first long, type string, at timestamp"


def latest(stream: DataFrame, late: str = "1 hour", kept_hours: float = 24 * 30) -> DataFrame:
    """Of a stream (branch_id, first, type, at: timestamp) the decisions that are the latest so far on their candidate, as they come;
    of equally late ones the greatest type. Repeated and overtaken ones give no row.

    Decisions more than `late` behind the stream are left out. A candidate's state ends once the stream is kept_hours past its last
    decision, so that the state is as large as what is being reviewed, not as all that ever was."""

    def one(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        best = before = state.get if state.exists else None
        for pdf in frames:
            for at, kind in zip(pdf["at"].astype("int64"), pdf["type"], strict=True):
                best = max(best, (int(at), kind)) if best else (int(at), kind)
        state.update(best)
        unit = pdf["at"].dt.unit
        last = pd.Timestamp(best[0], unit=unit)
        state.setTimeoutTimestamp(max(int(last.value // 10**6 + kept_hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        if best != before:
            yield pd.DataFrame({"branch_id": [key[0]], "first": [key[1]], "type": [best[1]], "at": [last]})

    rows = stream.select(F.col("branch_id").cast("long").alias("branch_id"), F.col("first").cast("long").alias("first"), "type", "at").where("branch_id IS NOT NULL AND first IS NOT NULL AND type IS NOT NULL AND at IS NOT NULL")
    keyed = rows.withWatermark("at", late).groupBy("branch_id", "first")
    return keyed.applyInPandasWithState(one, LATEST, "at long, type string", "update", GroupStateTimeout.EventTimeTimeout)


def upserted(decisions: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the stream of latest(), a folder per batch: a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    to = decisions.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    return to.trigger(**(trigger or {"availableNow": True})).start()


def decided(spark: SparkSession, path: str) -> DataFrame:
    """(branch_id, first, type, at): the last decision on each candidate among all batches."""
    last = F.max(F.struct("at", "type")).alias("d")
    return spark.read.schema(LATEST).parquet(path).groupBy("branch_id", "first").agg(last).select("branch_id", "first", "d.type", "d.at")


def reviewed(found: DataFrame, path: str) -> DataFrame:
    """Candidates with the type that they have by now, UNKNOWN without a decision."""
    return detect.review(found, decided(found.sparkSession, path))
