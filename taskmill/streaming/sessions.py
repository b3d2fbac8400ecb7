"""Sessions of an event stream, and events that come again; the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def without_repeats(events: DataFrame, by: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """events with each id once. On a stream, a repeat is known for as long as the watermark, `late`
    behind the newest event, hasn't passed the first (dropDuplicatesWithinWatermark); on a table all are,
    and of equal ids the one with the least ts stays. Rows without an id are one id's."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([by])
    names = events.columns
    first = events.groupBy(by).agg(F.min(F.struct(ts, *[c for c in names if c not in (ts, by)])).alias("_first"))
    return first.select(*[F.col(by) if c == by else F.col("_first")[c].alias(c) for c in names])


def sessions(events: DataFrame, by: str = "user_id", ts: str = "ts", gap: str = "30 minutes", value: str = "value", late: str | None = "1 hour", part_seconds: int = 86_400) -> DataFrame:
    """by, session_start, session_end, n, total: events of a key, each at most `gap` after the one
    before. The end is the last event's time and the gap. Rows without a key are one key's, rows
    without a time are in no session.

    On a stream these are Spark's session windows, under a watermark `late` behind (None: the stream
    has one). On a table a key with very many events isn't one task: sessions are made within parts
    of time first, and those few are then joined where they touch.
    """
    if events.isStreaming:
        source = events if late is None else events.withWatermark(ts, late)
        made = source.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        return made.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    e = events.filter(F.col(ts).isNotNull()).select(by, F.col(ts).alias("_ts"), F.col(value).alias("_value"))
    parts = e.groupBy(by, F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / (part_seconds * 1_000_000)).alias("_part"), F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("total"))
    of_key = W.partitionBy(by).orderBy("start", "end")
    p = parts.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    p = p.withColumn("before", F.max("end").over(of_key.rowsBetween(W.unboundedPreceding, -1)))
    p = p.withColumn("number", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before"))).over(of_key))
    out = p.groupBy(by, "number").agg(F.min("start").alias("session_start"), F.max("end").alias("session_end"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.drop("number")

