"""The manifest log as a stream: announcements that arrive are appended once, and the snapshot follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.visibility import active


def activate(announcements: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of manifest rows to the log, each micro-batch in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return announcements.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(log: DataFrame) -> DataFrame:
    """The active paths of a log, whatever the order its batches arrived in."""
    return active(log)
