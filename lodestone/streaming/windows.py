"""An addition of ours: evaluation is batch, but a metric over time is one windowed aggregation on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_over_time(events: DataFrame, time_col: str, value_col: str, window: str = "1 day", late: str = "1 hour", *keys: str) -> DataFrame:
    """Per tumbling window (and keys) the count and mean of a value. On a stream rows later than `late` are left out and closed windows are dropped from state."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time_col, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.avg(value_col), 6).alias("mean"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean")
