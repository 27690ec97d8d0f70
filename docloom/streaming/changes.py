"""Notes as a stream of changes, a segment of the store for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.notestore import NoteStore
from ..storage import scratch


def upsert_stream(changes: DataFrame, path: str, checkpoint: str):
    """Starts a query that applies a stream of changes (note columns, `deleted`) to the NoteStore below path.

    Each batch is one segment under its number, so a repeated batch changes nothing, and a batch
    writes as much as it changes.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        NoteStore(batch.sparkSession, path).apply(batch, epoch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files below path as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def replay(spark: SparkSession, changes: DataFrame) -> NoteStore:
    """The notes that a stream of these changes ends in, beginning with none."""
    folder = scratch(spark, "stream")
    changes.write.parquet(f"{folder}/in")
    upsert_stream(watch(spark, f"{folder}/in", changes.schema), f"{folder}/out", f"{folder}/state").awaitTermination()
    return NoteStore(spark, f"{folder}/out")
