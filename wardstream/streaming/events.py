"""Streaming twin of the hourly windows (an extension: there is no streaming to match)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "2 hours", ts: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """Count, least, largest and mean value per key and sliding window; rows later than `late` are left out by the watermark."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = e.groupBy(key, F.window("_ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "mean")
