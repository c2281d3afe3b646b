"""Sessions of a stream by gaps in time: the streaming counterpart of gap clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key, emitted once the watermark has passed them; works on batches alike."""
    grouped = events.withWatermark(ts, late) if events.isStreaming else events
    return grouped.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
