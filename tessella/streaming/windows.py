"""Event-time windows with watermarks, an addition of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed(events: DataFrame, time: str, size: str, by: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones, as window_start, the keys and the aggregates. late: how late a row may come."""
    rows = events.withColumn("__ts", F.col(time).cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark("__ts", late)
    w = F.window("__ts", size, slide) if slide else F.window("__ts", size)
    grouped = rows.groupBy(w.alias("w"), *by).agg(*aggregates)
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *grouped.columns[1:])


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Runs of rows of a key that are nearer than the gap."""
    rows = events.withColumn("__ts", F.col(time).cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark("__ts", late)
    out = rows.groupBy(F.session_window("__ts", gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *out.columns[1:])


def deduplicated(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; in a stream, among those not later than ``late``."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([key]).drop("__ts")
