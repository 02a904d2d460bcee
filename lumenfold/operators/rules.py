"""Diagnosis of the latest window against the one before it.

One wide frame holds a row for each product: traffic and orders are each read once, cut to both windows by literal dates,
and reduced by conditional aggregates. Orders are first reduced to one row for each (product, order), so distinct counts
need no expansion. All rule views derive from that frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import change_rate, first_match, ratio
from ..sources.schemas import Tables
from .windows import Windows, as_of

DAYS, TOP = 30, 10


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the rules."""

    refund: float = 0.12
    drop: float = -0.30
    conversion: float = -0.01
    decline: float = -0.20


LIMITS = Thresholds()


def latest(tables: Tables, days: int = DAYS) -> Windows:
    return Windows.latest(as_of(tables.traffic), days)


def product_metrics(tables: Tables, windows: Windows) -> DataFrame:
    """Per product, for each window: observed days, visits, orders, gmv, refunds; and the ratios of these."""
    seen = ~F.col("is_missing")
    traffic = tables.traffic.where(windows.either("date")).groupBy("product_id").agg(
        *[F.count_if(windows.within("date", p) & seen).alias(f"{p}_observed_days") for p in windows.periods],
        *[F.sum(F.when(windows.within("date", p) & seen, F.col("visits"))).alias(f"{p}_visits") for p in windows.periods],
    )
    orders = (
        tables.orders.where(windows.either("order_date"))
        .groupBy("product_id", "order_id")
        .agg(
            *[F.sum(F.when(windows.within("order_date", p), F.col("revenue"))).alias(f"{p}_gmv") for p in windows.periods],
            *[F.max(windows.within("order_date", p).cast("int")).alias(f"{p}_orders") for p in windows.periods],
            *[F.max((windows.within("order_date", p) & F.col("is_refund")).cast("int")).alias(f"{p}_refunds") for p in windows.periods],
        )
        .groupBy("product_id")
        .agg(*[F.sum(f"{p}_{m}").alias(f"{p}_{m}") for p in windows.periods for m in ("gmv", "orders", "refunds")])
    )
    wide = tables.products.select("product_id").join(traffic, "product_id", "left").join(orders, "product_id", "left")
    counts = [c for c in wide.columns if c != "product_id"]
    wide = wide.select("product_id", *[F.coalesce(F.col(c).cast("double" if c.endswith("gmv") else "long"), F.lit(0)).alias(c) for c in counts])
    return wide.select(
        "*",
        *[ratio(f"{p}_orders", f"{p}_visits").alias(f"{p}_raw_cvr") for p in windows.periods],
        *[F.when(F.col(f"{p}_observed_days") == windows.days(p), ratio(f"{p}_orders", f"{p}_visits")).alias(f"{p}_cvr") for p in windows.periods],
        *[ratio(f"{p}_gmv", f"{p}_orders").alias(f"{p}_aov") for p in windows.periods],
        ratio("current_refunds", "current_orders").alias("current_refund_rate"),
        change_rate("current_visits", "previous_visits").alias("traffic_change_rate"),
        change_rate("current_gmv", "previous_gmv").alias("gmv_change_rate"),
    ).select(
        "*",
        (F.col("current_cvr") - F.col("previous_cvr")).alias("cvr_change"),
        change_rate("current_aov", "previous_aov").alias("aov_change_rate"),
        ((F.col("current_observed_days") < windows.days("current")) | (F.col("previous_observed_days") < windows.days("previous"))).alias("gaps"),
    )


@dataclass(frozen=True)
class Frame:
    """The latest windows and the wide frame over them, which all rules read."""

    windows: Windows
    wide: DataFrame


#: A frame of at most so many products is fetched to be read several times.
SETTLED = 10_000


def frame(tables: Tables, days: int = DAYS, *, settle: bool = False) -> Frame:
    """The frame of the rules; ``settle`` computes it now, for callers that read it several times. It has a row a product;
    where there are more than ``SETTLED``, it stays a plan."""
    windows = latest(tables, days)
    wide = product_metrics(tables, windows)
    if settle:
        rows = wide.limit(SETTLED + 1).collect()
        if len(rows) <= SETTLED:
            wide = wide.sparkSession.createDataFrame(rows, wide.schema)
    return Frame(windows, wide)


def gmv_change(tables: Tables, days: int = DAYS, *, given: Frame | None = None) -> DataFrame:
    """One row, also where there are no orders."""
    windows = given.windows if given else latest(tables, days)
    per_order = tables.orders.where(windows.either("order_date")).groupBy("order_id").agg(
        *[F.sum(F.when(windows.within("order_date", p), F.col("revenue"))).alias(f"{p}_gmv") for p in windows.periods],
        *[F.max(windows.within("order_date", p).cast("int")).alias(f"{p}_orders") for p in windows.periods],
    )
    total = per_order.agg(*[F.coalesce(F.sum(f"{p}_gmv").cast("double"), F.lit(0.0)).alias(f"{p}_gmv") for p in windows.periods], *[F.coalesce(F.sum(f"{p}_orders"), F.lit(0)).cast("long").alias(f"{p}_orders") for p in windows.periods])
    total = total.select("*", *[ratio(f"{p}_gmv", f"{p}_orders").alias(f"{p}_aov") for p in windows.periods])
    return total.select(*windows.columns(), "*", change_rate("current_gmv", "previous_gmv").alias("gmv_change_rate"), change_rate("current_aov", "previous_aov").alias("aov_change_rate"))


def product_anomalies(tables: Tables, days: int = DAYS, *, given: Frame | None = None) -> DataFrame:
    given = given or frame(tables, days)
    windows = given.windows
    traffic_fell, sales_fell = F.col("traffic_change_rate") <= LIMITS.drop, F.col("gmv_change_rate") <= LIMITS.drop
    kind = F.coalesce(
        F.when(F.col("gaps"), "missing_traffic"),
        F.when(F.col("current_refund_rate") >= LIMITS.refund, "high_refund"),
        F.when(traffic_fell & sales_fell, "multi_factor_drop"),
        F.when(traffic_fell, "traffic_drop"),
        F.when(F.col("cvr_change") <= LIMITS.conversion, "conversion_drop"),
        F.when(sales_fell & (F.col("aov_change_rate") <= LIMITS.drop), "sales_drop"),
    )
    found = given.wide.withColumn("anomaly_type", kind).where(F.col("anomaly_type").isNotNull())
    shown = ["product_id", "anomaly_type", "traffic_change_rate", "current_cvr", "previous_cvr", "current_refund_rate", "gmv_change_rate", "aov_change_rate", "current_observed_days", "previous_observed_days"]
    return found.select(*windows.columns(), *shown).orderBy("product_id")


def conversion_decline(tables: Tables, days: int = DAYS, top: int = TOP, *, given: Frame | None = None) -> DataFrame:
    given = given or frame(tables, days)
    windows = given.windows
    found = given.wide.where("cvr_change < 0")
    shown = ["product_id", "current_cvr", "previous_cvr", "cvr_change", *[f"{p}_{m}" for m in ("orders", "visits", "observed_days") for p in windows.periods]]
    return found.select(*windows.columns(), *shown).orderBy("cvr_change", "product_id").limit(top)


def products_to_watch(tables: Tables, days: int = DAYS, top: int = TOP, *, given: Frame | None = None) -> DataFrame:
    given = given or frame(tables, days)
    windows = given.windows
    branches = [
        (F.col("gaps"), "data_quality_review"),
        (F.col("current_refund_rate") >= LIMITS.refund, "refund_risk"),
        (F.col("cvr_change") <= LIMITS.conversion, "conversion_decline"),
        (F.col("gmv_change_rate") <= LIMITS.decline, "gmv_decline"),
    ]
    hit = first_match(*[(test, {"rank": F.lit(k), "reason": F.lit(reason)}) for k, (test, reason) in enumerate(branches)])
    found = given.wide.withColumn("hit", hit).where("hit is not null").orderBy("hit.rank", "product_id").limit(top)
    return found.select(*windows.columns(), "product_id", F.col("hit.reason").alias("watch_reason"), "gmv_change_rate", "cvr_change", F.col("current_refund_rate").alias("refund_rate"), "current_observed_days", "previous_observed_days").orderBy("hit.rank", "product_id")


def next_week_priorities(tables: Tables, days: int = DAYS, top: int = TOP, *, given: Frame | None = None) -> DataFrame:
    given = given or frame(tables, days)
    windows = given.windows
    least = F.least("current_observed_days", "previous_observed_days").cast("double")
    branches = [
        (F.col("gaps"), "repair_data_quality", "observed_days", least),
        (F.col("current_refund_rate") >= LIMITS.refund, "investigate_refunds", "refund_rate", F.col("current_refund_rate")),
        (F.col("cvr_change") <= LIMITS.conversion, "recover_conversion", "cvr_change", F.col("cvr_change")),
        (F.col("traffic_change_rate") <= LIMITS.decline, "recover_traffic", "traffic_change_rate", F.col("traffic_change_rate")),
    ]
    hit = first_match(*[(test, {"rank": F.lit(k), "reason": F.lit(reason), "metric": F.lit(metric), "value": value}) for k, (test, reason, metric, value) in enumerate(branches)])
    order = [F.col("hit.rank"), F.abs(F.col("hit.value")).desc(), F.col("product_id")]
    found = given.wide.withColumn("hit", hit).where("hit is not null").orderBy(*order).limit(top)
    return found.select(*windows.columns(), "product_id", F.col("hit.reason").alias("priority_reason"), F.col("hit.metric").alias("evidence_metric"), F.col("hit.value").alias("evidence_value"), "current_observed_days", "previous_observed_days").orderBy(*order)


RULES = {
    "gmv_change": gmv_change,
    "product_anomalies": product_anomalies,
    "conversion_decline": conversion_decline,
    "products_to_watch": products_to_watch,
    "next_week_priorities": next_week_priorities,
}
