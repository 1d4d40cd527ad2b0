"""Event-time windows: the same functions serve batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, at: str, late: str | None) -> DataFrame:
    timed = df.withColumn(at, F.col(at).cast("timestamp"))  # windows on an instant; the session zone is UTC
    return timed.withWatermark(at, late) if late else timed


def tumbling(df: DataFrame, at: str, width: str, key: str, value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, key, n, total) of tumbling, or with ``slide`` sliding, windows."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    grouped = _timed(df, at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), key, "n", "total")


def sessions(df: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(start, end, key, n) of sessions that end after a gap."""
    grouped = _timed(df, at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), key, "n")
