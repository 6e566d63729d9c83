"""Progress of runs as streams of events: windowed counts with a watermark, and the state of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of Parquet files that arrive in a folder; times are in the session's zone."""
    found = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): events later than the watermark are left out; works on a batch as on a stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    counted = kept.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with no gap of that length."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    found = kept.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def progress_lines(steps: DataFrame) -> DataFrame:
    """Steps as newline-delimited JSON events, ready for a text or Kafka sink."""
    return steps.select(F.to_json(F.struct(F.lit("step-complete").alias("event"), F.col("conv_id").alias("run"), F.col("turn").alias("step"), "status")).alias("value"))
