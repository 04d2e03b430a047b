"""A windowed aggregate that runs as a batch or as a stream; an extra, the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """(start, event_type, n) by tumbling hour; on a stream give how late rows may be, and older state is dropped."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")
