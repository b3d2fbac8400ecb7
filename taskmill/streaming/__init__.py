"""Progress of runs over an event stream. The definition is our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value per window and kind; works on streams (with watermark) and tables."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    counted = source.groupBy(F.window(ts, width).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n", "total")
