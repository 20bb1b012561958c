"""Resampling and sessions of unbounded input: an extension, with bounded state by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_resample(stream: DataFrame, key: str, time: str, columns: list[str], epoch: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Means and rows of each key and epoch; rows later than the watermark are left out."""
    aggs = [F.avg(c).alias(c) for c in columns]
    out = stream.withWatermark(time, late).groupBy(key, F.window(time, epoch).alias("w")).agg(*aggs, F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("epoch"), *columns, "n")


def stream_sessions(stream: DataFrame, key: str, time: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start_time, stop_time, n): rows of a key no more than a gap apart."""
    out = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("start_time"), F.max(time).alias("stop_time"), F.count("*").alias("n"))
    return out.drop("w")
