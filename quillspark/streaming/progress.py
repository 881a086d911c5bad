"""Streaming forms of the append-only tables: page status as it arrives, and turns kept by thread.

The report application only appends to a manifest and to threads; these read such a table as a stream. They are an
extension, with watermarks so that state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_status(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and value of each kind in each window; rows later than ``late`` behind the newest are dropped with their state."""
    held = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return held.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    held = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return held.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return its rows; for tests and small tables."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
