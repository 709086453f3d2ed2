"""The job queue and its heartbeats as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run(jobs: DataFrame, handle: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Handle queued jobs batch by batch and append their outcomes; a batch that is run again overwrites itself."""

    def batch(df: DataFrame, epoch: int) -> None:
        queued = df.where(F.col("status") == "QUEUED")
        handle(queued).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    writer = jobs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def beats(events: DataFrame, key: str, at: str, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Sessions of heartbeats: one ends when none has come for the gap; later ones than late are dropped with their state."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("beats")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "beats")


def windowed(events: DataFrame, at: str, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), *keys).agg(F.count("*").alias("n"))
