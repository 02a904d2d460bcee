"""Streaming counterpart of the daily traffic table: an extension, nothing else depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_traffic(events: DataFrame, *, delay: str = "1 day", entity: str = "user_id", cohorts: int = 60) -> DataFrame:
    """Views, clicks and visits by day and cohort of an event stream (ts, user_id, event_type); works on batches too.

    State is kept for the days within ``delay`` of the latest event; later events are dropped by the watermark.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", delay)
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    product = F.concat(F.lit("P"), F.lpad((F.col(entity) % cohorts).cast("string"), 3, "0"))
    grouped = stamped.where(F.col("event_type").isin("view", "click", "signup")).groupBy(F.window("ts", "1 day").alias("day"), product.alias("product_id"))
    return grouped.agg(kind("view", "click").alias("impressions"), kind("click").alias("clicks"), kind("click", "signup").alias("visits")).select(F.col("day.start").cast("date").alias("date"), "product_id", "impressions", "clicks", "visits")
