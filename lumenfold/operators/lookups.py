"""Parameterised queries over two windows: products, sales, traffic and marketing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import Tables
from .windows import Windows

PRODUCT_ID = re.compile(r"P[0-9]{3}")


def check_ids(product_ids, *, required: bool = False) -> list[str]:
    ids = list(product_ids)
    if required and not ids:
        raise ValueError("at least one product id is needed")
    if len(set(ids)) != len(ids):
        raise ValueError("product ids repeat")
    if bad := [i for i in ids if not PRODUCT_ID.fullmatch(i)]:
        raise ValueError(f"not product ids: {bad}")
    return ids


def _chosen(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.where(F.col("product_id").isin(ids)) if ids else df


def query_product(tables: Tables, product_ids) -> DataFrame:
    ids = check_ids(product_ids, required=True)
    return _chosen(tables.products, ids).select("product_id", "product_name", "category", "price", "cost", "launch_date").orderBy("product_id")


def query_sales(tables: Tables, windows: Windows, product_ids=(), include_refunds: bool = True) -> DataFrame:
    """Sales by period, product, category, region and channel; orders without a known product or customer are left out."""
    orders = _chosen(windows.tagged(tables.orders, "order_date"), check_ids(product_ids))
    if not include_refunds:
        orders = orders.where(~F.col("is_refund"))
    known = orders.join(tables.products.select("product_id", "category"), "product_id").join(tables.customers.select("customer_id", "region", "channel"), "customer_id")
    by = ["period", "product_id", "category", "region", "channel"]
    per_order = known.groupBy(*by, "order_id").agg(F.sum("revenue").alias("gmv"), F.sum("quantity").alias("units"), F.max(F.col("is_refund").cast("int")).alias("refunded"))
    return (
        per_order.groupBy(*by)
        .agg(F.sum("gmv").cast("double").alias("gmv"), F.count("*").alias("orders"), F.sum("units").alias("units"), F.sum("refunded").cast("long").alias("refund_orders"))
        .orderBy("period", "product_id", "region", "channel")
    )


def query_traffic(tables: Tables, windows: Windows, product_ids=(), include_missing: bool = True) -> DataFrame:
    """Traffic by period and product over every day of the window; a day without a row counts as missing.

    The calendar has one row a product and day; the traffic is cut to both windows before it is joined. A product and
    period with a repeated day (observed and missing days no longer add up to the window) is left out.
    """
    products = _chosen(tables.products.select("product_id", "category"), check_ids(product_ids))
    spans = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, (a, b) in windows.periods.items()])
    grid = products.select("product_id", "category", F.inline(spans)).select("product_id", "category", "period", F.explode(F.sequence("a", "b")).alias("date"))
    traffic = tables.traffic.where(windows.either("date")).withColumn("seen", ~F.col("is_missing"))
    joined = grid.join(traffic, ["product_id", "date"], "left")
    seen = F.coalesce("seen", F.lit(False))
    totals = joined.groupBy("period", "product_id", "category").agg(
        *[F.coalesce(F.sum(F.when(seen, F.col(m))), F.lit(0)).cast("long").alias(m) for m in ("impressions", "clicks", "visits")],
        F.count_if(seen).alias("observed_days"),
        F.count_if(~seen).alias("missing_days"),
    )
    expected = F.when(F.col("period") == "current", windows.days("current")).otherwise(windows.days("previous"))
    totals = totals.where(F.col("observed_days") + F.col("missing_days") == expected)
    if not include_missing:
        totals = totals.where("missing_days = 0")
    return totals.orderBy("period", "product_id")


def query_marketing(tables: Tables, windows: Windows, product_ids=()) -> DataFrame:
    rows = _chosen(windows.tagged(tables.marketing, "date"), check_ids(product_ids)).join(tables.products.select("product_id", "category"), "product_id")
    by = ["period", "product_id", "category", "campaign_id"]
    return rows.groupBy(*by).agg(F.sum("spend").cast("double").alias("spend")).orderBy(*by)
