"""Counts over an append-only log of requests, as a stream. The batch tables have no counterpart of this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(log: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) by tumbling window; rows later than ``late`` are dropped by the watermark when streamed."""
    timed = log.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if log.isStreaming else timed
    by = timed.groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("start"), kind, "n", "total")
