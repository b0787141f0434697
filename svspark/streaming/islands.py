"""Islands over a stream: session windows close once the watermark has passed their gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_islands(points: DataFrame, time: str, keys: list[str], gap: str, delay: str = "0 seconds") -> DataFrame:
    """Gap-and-island clusters of a stream with an event time: keys, start, last, n.

    Equals the batch operator for input that arrives at most ``delay`` late; state holds open
    sessions only. Works on batch input too. Rows with a null time are dropped.
    """
    rows = points.where(F.col(time).isNotNull()).withWatermark(time, delay)
    w = F.session_window(F.col(time), gap)
    return rows.groupBy(*keys, w).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n")).drop("session_window")
