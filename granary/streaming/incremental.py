"""Deduplication of a stream of chunks that keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.sources.store import Store


def first_chunks(chunks: DataFrame) -> DataFrame:
    """Of a streaming chunk table the first row of each fingerprint; the state store
    holds the fingerprints."""
    return chunks.dropDuplicates(["fp"])


def windowed_counts(events: DataFrame, column: str, window: str, late: str) -> DataFrame:
    """Rows and bytes in windows of event time; rows later than `late` are left out."""
    return events.withWatermark(column, late).groupBy(F.window(column, window)).agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


def backup_stream(files: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Backs up each micro-batch of a stream of files (file_id, file_name, data) as a
    version of the store. A version's log entry names its batch, so a batch that is run
    again after a failure is stored once."""

    def save(batch: DataFrame, number: int) -> None:
        note = f"batch {number} of {checkpoint}"
        if not batch.isEmpty() and all(e.get("note") != note for e in store.entries()):
            store.backup(batch, note)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
