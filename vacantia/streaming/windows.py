"""Event-time windows over an event stream (columns ts, user_id, event_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamped(events: DataFrame) -> DataFrame:
    """Event time as a timestamp: watermarks reject the zoneless type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, *, late: str | None = None) -> DataFrame:
    e = stamped(events)
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return stamped(events).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    s = stamped(events).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_per_key(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark (streaming) or of all (batch)."""
    e = stamped(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)
