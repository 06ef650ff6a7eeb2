"""Structured Streaming forms of what is incremental: event windows, sessions, and score upserts.

An extension: the batch operators do not depend on it. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators.orphans import counts_of, merge_counts


def windowed(events: DataFrame, at: str, key: str, value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) by tumbling event-time windows; rows later than ``late`` are dropped."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, every), key)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")
    )


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, session_start, session_end, n) of bursts of events no further apart than ``gap``."""
    return (
        events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
        .select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
    )


def maintain_counts(references: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the signed reference and existence counts of ``operators.orphans`` up to date from a stream of deltas.

    The stream has (key, at, delta, is_record). Every micro-batch writes a new state beside the old one
    and is idempotent: a repeated batch reads the same predecessor.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        change = counts_of(batch.where(~F.col("is_record")), batch.where("is_record"))
        state = spark.read.parquet(f"{path}/{batch_id - 1}") if batch_id else spark.createDataFrame([], change.schema)
        merge_counts(state, change).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return references.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def run(query: DataFrame, name: str, mode: str, checkpoint: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a stream to a memory table, or to ``each`` per micro-batch."""
    writer = query.writeStream.outputMode(mode).queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.foreachBatch(each) if each else writer.format("memory")).start()
