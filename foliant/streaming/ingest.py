"""Continuous ingestion and event timelines with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.archive import Archive, discover

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def follow(spark: SparkSession, root: str, archive: Archive, checkpoint: str, once: bool = True):
    """Feeds files that appear under ``root`` to an archive.  Updates are keyed by content, so a batch that runs twice changes nothing."""

    def update(files: DataFrame, _batch: int) -> None:
        archive.update(discover(files, root))

    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)
    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and tumbling window; works on streams, whose late events a watermark bounds, and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row per user and session of events no further apart than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
