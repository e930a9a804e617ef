"""Call features over a stream (an extension: the batch forms are the rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_calls(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, user_id, calls, total): event-time hours with a watermark; ts
    must be a timestamp. Works on a stream and on a table alike."""
    return events.filter("event_type <> 'purchase'").withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("calls"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "user_id", "calls", "total")
