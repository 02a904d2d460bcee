"""Daily key figures and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from ..sources.schemas import Tables


def daily_kpis(tables: Tables) -> DataFrame:
    """One row a traffic date; CTR and CVR only on days observed in full; refunds count rows."""
    seen = ~F.col("is_missing")
    traffic = tables.traffic.groupBy("date").agg(F.count("*").alias("total_rows"), F.count_if(seen).alias("observed_rows"), *[F.sum(F.when(seen, F.col(m))).alias(m) for m in ("impressions", "clicks", "visits")])
    per_order = tables.orders.groupBy(F.col("order_date").alias("date"), "order_id").agg(F.sum("revenue").alias("gmv"), F.count_if("is_refund").alias("refunds"))
    orders = per_order.groupBy("date").agg(F.sum("gmv").alias("gmv"), F.count("*").alias("orders"), F.sum("refunds").alias("refunds"))
    spend = tables.marketing.groupBy("date").agg(F.sum("spend").alias("spend"))
    day = traffic.join(orders, "date", "left").join(spend, "date", "left")
    full = F.col("observed_rows") == F.col("total_rows")
    return day.select(
        "date",
        "observed_rows",
        "total_rows",
        ratio("observed_rows", "total_rows").alias("coverage"),
        F.col("gmv").cast("double").alias("GMV"),
        F.col("orders").alias("Orders"),
        ratio("gmv", "orders").alias("AOV"),
        F.when(full, ratio("clicks", "impressions")).alias("CTR"),
        F.when(full, ratio("orders", "visits")).alias("CVR"),
        ratio("refunds", "orders").alias("Refund Rate"),
        ratio("gmv", "spend").alias("ROAS"),
    ).orderBy("date")


def coverage_gaps(kpis: DataFrame) -> DataFrame:
    return kpis.where("coverage < 1").select("date", "observed_rows", "total_rows", "coverage").orderBy("date")


def summary_stats(kpis: DataFrame, columns=("coverage", "GMV", "Orders", "AOV", "CTR", "CVR", "Refund Rate", "ROAS")) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, one row a column."""
    stats = [F.count, F.mean, F.stddev, F.min, F.max]
    cells = kpis.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{c}|{k}") for c in columns for k, f in enumerate(stats)], *[F.percentile(F.col(f"`{c}`").cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}|q") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}|0`").alias("count"), *[F.col(f"`{c}|{k}`").cast("double").alias(n) for k, n in ((1, "mean"), (2, "std"), (3, "min"))], *[F.col(f"`{c}|q`")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))], F.col(f"`{c}|4`").alias("max")) for c in columns])
    return cells.select(F.inline(rows)).orderBy("metric")


def hand_check(orders: DataFrame, impressions: int, clicks: int, visits: int, spend: float) -> DataFrame:
    """Seven base metrics over order rows with a known status; one row."""
    valid = orders.where(F.col("status").isin("paid", "refunded"))
    total = valid.agg(F.sum("revenue").cast("double").alias("gmv"), F.count_distinct("order_id").alias("orders"), F.count_distinct(F.when(F.col("is_refund"), F.col("order_id"))).alias("refunds"))
    return total.select(
        F.coalesce("gmv", F.lit(0.0)).alias("gmv"),
        "orders",
        ratio("gmv", "orders").alias("aov"),
        ratio(F.lit(clicks), F.lit(impressions)).alias("ctr"),
        ratio("orders", F.lit(visits)).alias("cvr"),
        ratio("refunds", "orders").alias("refund_rate"),
        ratio("gmv", F.lit(spend)).alias("roas"),
    )
