"""The test tables read as the five base tables.

``funnel`` reads events: a cohort of users (user_id modulo 60) is a product, views and clicks are impressions, clicks and
signups are visits, purchases are orders and signups carry marketing spend. ``commerce`` reads the order tables, for sales
only: a brand is a product, and an order may span several products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import Tables

COHORTS = 60
DAYS = 15


def funnel(spark, sf_dir: str) -> Tables:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("date").alias("date"), "user_id", "event_type", "value")
    cohort = F.col("user_id") % COHORTS
    name = F.concat(F.lit("P"), F.lpad(cohort.cast("string"), 3, "0"))
    events = events.withColumn("product_id", name)
    price = (10 + F.col("n") % 7).cast("decimal(18,2)")
    products = events.select(cohort.alias("n"), "product_id").distinct().select(
        "product_id",
        F.concat(F.lit("Cohort "), F.col("n").cast("string")).alias("product_name"),
        F.concat(F.lit("K"), (F.col("n") % 4).cast("string")).alias("category"),
        price.alias("price"),
        (price - 5).cast("decimal(18,2)").alias("cost"),
        F.lit("2023-01-01").cast("date").alias("launch_date"),
    )
    number = F.col("user_id").cast("string")
    customer = F.concat(F.lit("C"), F.when(F.char_length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))  # longer numbers stay whole
    customers = events.select("user_id").distinct().select(
        customer.alias("customer_id"),
        (F.col("user_id") % 5 == 0).alias("is_new_customer"),
        F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string")).alias("region"),
        F.concat(F.lit("H"), (F.col("user_id") % 3).cast("string")).alias("channel"),
    )
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    traffic = events.where(F.col("event_type").isin("view", "click", "signup")).groupBy("date", "product_id").agg(kind("view", "click").alias("impressions"), kind("click").alias("clicks"), kind("click", "signup").alias("visits"))
    traffic = traffic.withColumn("is_missing", F.lit(False))
    spend = F.col("value").cast("decimal(18,2)")
    marketing = events.where("event_type = 'signup'").groupBy("date", "product_id", F.concat(F.lit("M"), F.lpad((F.col("event_id") % 3).cast("string"), 3, "0")).alias("campaign_id")).agg(F.sum(spend).cast("decimal(18,2)").alias("spend"))
    refund = F.col("value") < 5
    orders = events.where("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("order_id"),
        "product_id",
        customer.alias("customer_id"),
        F.col("date").alias("order_date"),
        F.lit(1).cast("long").alias("quantity"),
        spend.alias("unit_price"),
        spend.alias("revenue"),
        refund.alias("is_refund"),
        F.when(refund, "refunded").otherwise("paid").alias("status"),
    )
    return Tables(products, customers, traffic, marketing, orders)


def commerce(spark, sf_dir: str) -> Tables:
    """Sales tables; traffic and marketing are empty."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    part = read("part").select("p_partkey", "p_brand", "p_type", "p_name", "p_retailprice")
    products = part.groupBy(F.col("p_brand").alias("product_id")).agg(
        F.min("p_name").alias("product_name"), F.min("p_type").alias("category"), F.max("p_retailprice").cast("decimal(18,2)").alias("price"), F.min("p_retailprice").cast("decimal(18,2)").alias("cost")
    ).withColumn("launch_date", F.lit("1990-01-01").cast("date"))
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("customer_id"), F.lit(False).alias("is_new_customer"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("channel"))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    heads = read("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"))
    revenue, refund = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_returnflag") == "R"
    orders = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("p_brand").alias("product_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        "order_date",
        F.col("l_quantity").cast("long").alias("quantity"),
        revenue.alias("unit_price"),
        revenue.alias("revenue"),
        refund.alias("is_refund"),
        F.when(refund, "refunded").otherwise("paid").alias("status"),
    )
    spark = orders.sparkSession
    return Tables(products, customers, spark.createDataFrame([], "date date, product_id string, impressions bigint, clicks bigint, visits bigint, is_missing boolean"), spark.createDataFrame([], "date date, product_id string, campaign_id string, spend decimal(18,2)"), orders)
