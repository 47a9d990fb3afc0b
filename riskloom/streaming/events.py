"""Streaming forms: the same features over an event stream, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    """Parquet files as they come, a few a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need session-zone times; naive ones are read in the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, key: str, time: str, value: str, width: str, late: str) -> DataFrame:
    """Count, sum, least and largest value per entity and window; rows later than ``late`` behind the newest are dropped.

    The windows stand on the clock, not on each entity's reference time as batch slices do.
    """
    w = F.window(time, width)
    out = _timed(events, time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(key, F.col("w.start").alias("window_start"), "n", "total", "least", "most")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Runs of events with no pause longer than ``gap``."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def write_stream(rows: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to Parquet; the checkpoint makes restarts exact."""
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
