"""Windowed statistics of events; the same functions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, slide: str | None = None, *, late: str | None = None) -> DataFrame:
    """start, event_type, n, total by window; on a stream, events more than ``late`` behind are dropped and state is bounded."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


def sessions(events: DataFrame, gap: str, *, late: str | None = None) -> DataFrame:
    """user_id, start, n of the runs of a user's events without a longer gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def running_counters(events: DataFrame) -> DataFrame:
    """user_id, n, errors, last: counters by user; on a stream in update mode each batch gives the users that changed."""
    out = events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last"))
    return out.select("user_id", "n", "errors", "last")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key; on a stream a key is remembered for as long as late events may come."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def within_before(later: DataFrame, earlier: DataFrame, key: str, length: str, *, late: str | None = None) -> DataFrame:
    """Each later event with the earlier ones of its key within a length of time before it (its own time included): event_id, earlier_id."""
    a = later.select("event_id", F.col(key).alias("k"), F.col("ts").cast("timestamp").alias("t"))
    b = earlier.select(F.col("event_id").alias("earlier_id"), F.col(key).alias("k2"), F.col("ts").cast("timestamp").alias("t2"))
    if late:
        a, b = a.withWatermark("t", late), b.withWatermark("t2", late)
    near = (F.col("t2") <= F.col("t")) & (F.col("t2") > F.col("t") - F.expr(f"INTERVAL {length}"))
    return a.join(b, (F.col("k") == F.col("k2")) & near).select("event_id", "earlier_id")
