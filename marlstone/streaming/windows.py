"""Event-time windows over streams or tables: an extension for late data.

Each function takes a DataFrame with a time column; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Counts by window and keys."""
    return _timed(df, ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    return _timed(df, ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Counts by session: events of a key no further apart than the gap."""
    return _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"))
