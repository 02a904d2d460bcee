"""The window queries for a table of windows at once: each fact meets every window that holds its day.

A table of windows has ``window_id``, ``period`` (current or previous), ``start``, ``end`` (dates, both in) and
``product_ids`` (null or empty: all products); a window_id has one row a period. Days are dealt to bins of ``BIN_DAYS``; a
fact lies in one bin, a window in the few that it touches, and they meet by an equal-key join on the bin (and on the product,
where the window names products), after which only facts at a window's edges are compared. So rows grow with what the windows
hold, no pair is tried that shares no bin, and Spark may broadcast the windows, shuffle both sides, or split a large bin. The
first and last day of all windows are fetched (one row) and reach the scan as literals.

Results are those of ``lookups`` and ``derive`` for one pair of windows, with ``window_id`` in front.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import Tables
from . import derive
from .derive import PERIODS
from .windows import MAX_DAYS, Windows

BIN_DAYS = 16
SCHEMA = "window_id string, period string, start date, end date, product_ids array<string>"


def table(spark, windows: dict[str, tuple[Windows, list[str]]]) -> DataFrame:
    """A table of windows from pairs of windows and product ids by id."""
    rows = [(name, p, a, b, list(ids)) for name, (w, ids) in windows.items() for p, (a, b) in w.periods.items()]
    return spark.createDataFrame(rows, SCHEMA)


def broken(windows: DataFrame) -> DataFrame:
    """Windows that end before they start, span too many days, lack a value, or whose id and period repeat."""
    size = F.datediff("end", "start") + 1
    odd = F.col("window_id").isNull() | F.col("period").isNull() | ~F.col("period").isin(*PERIODS) | size.isNull() | ~size.between(1, MAX_DAYS)
    repeated = windows.groupBy("window_id", "period").agg(F.count("*").alias("n")).where("n > 1").select("window_id", "period")
    return windows.where(odd).select("window_id", "period").unionAll(repeated)


def _bin(day):
    return F.floor(F.unix_date(day) / BIN_DAYS)


def _bounds(windows: DataFrame):
    return windows.agg(F.min("start").alias("first"), F.max("end").alias("last")).first()


def within(facts: DataFrame, day: str, windows: DataFrame) -> DataFrame:
    """``facts`` (with product_id) once for each window that holds their day and product, with window_id and period."""
    found = _bounds(windows)
    facts = facts.where(F.col(day).between(F.lit(found["first"]).cast("date"), F.lit(found["last"]).cast("date"))).withColumn("_bin", _bin(day))
    cut = windows.select("window_id", "period", "start", "end", "product_ids", F.explode(F.sequence(_bin("start"), _bin("end"))).alias("_bin"))
    named = F.coalesce(F.size("product_ids"), F.lit(0)) > 0
    every = cut.where(~named).drop("product_ids")
    some = cut.where(named).select("window_id", "period", "start", "end", "_bin", F.explode(F.array_distinct("product_ids")).alias("product_id"))
    inside = F.col(day).between(F.col("start"), F.col("end"))
    parts = [facts.join(side, keys).where(inside).select("window_id", "period", *[c for c in facts.columns if c != "_bin"]) for side, keys in ((every, ["_bin"]), (some, ["_bin", "product_id"]))]
    return parts[0].unionAll(parts[1])


def query_sales(tables: Tables, windows: DataFrame, include_refunds: bool = True) -> DataFrame:
    """Sales by window, product, category, region and channel. A fact meets its product and customer once, not once a window.

    An order's rows of one product and place are added up by day first. Where all lie on one day, they are one order in
    every window that holds the day, so such orders are added up by day, and days meet the windows. An order of several days
    keeps its id until it is counted, as a window may hold some of the days, or all, and it counts once there.
    """
    orders = tables.orders if include_refunds else tables.orders.where(~F.col("is_refund"))
    found = _bounds(windows)
    orders = orders.where(F.col("order_date").between(F.lit(found["first"]).cast("date"), F.lit(found["last"]).cast("date")))
    orders = orders.select("order_id", "product_id", "customer_id", F.col("order_date").alias("day"), "quantity", "revenue", "is_refund")
    known = orders.join(tables.products.select("product_id", "category"), "product_id").join(tables.customers.select("customer_id", "region", "channel"), "customer_id")
    place = ["product_id", "category", "region", "channel"]
    totals = [F.sum(c).alias(c) for c in ("gmv", "units", "orders", "refunded")]
    # dealt by order once, which both groupings below and the count of days keep
    dealt = known.drop("customer_id").repartition("order_id")
    daily = dealt.groupBy("order_id", *place, "day").agg(F.sum("revenue").alias("gmv"), F.sum("quantity").alias("units"), F.max(F.col("is_refund").cast("long")).alias("refunded"))
    apart = F.count("*").over(Window.partitionBy("order_id", *place)) > 1
    daily = daily.withColumn("apart", apart).withColumn("order_id", F.when(F.col("apart"), F.col("order_id"))).withColumn("orders", F.lit(1).cast("long"))
    by = ["window_id", "period", *place]
    held = within(daily.groupBy(*place, "day", "apart", "order_id").agg(*totals), "day", windows).groupBy(*by, "apart", "order_id").agg(*totals)
    once = [F.when(F.col("apart"), F.least(F.col(c), F.lit(1))).otherwise(F.col(c)).alias(c) for c in ("orders", "refunded")]
    counted = held.select(*by, "gmv", "units", *once).groupBy(*by).agg(*totals)
    return counted.select(*by, F.col("gmv").cast("double").alias("gmv"), "orders", "units", F.col("refunded").alias("refund_orders"))


def _asked(tables: Tables, windows: DataFrame) -> DataFrame:
    """window_id, period, days, product_id, category: the products of each window. Windows without ids meet all products
    by the bin of their first day."""
    found = _bounds(windows)
    sized = windows.withColumn("days", F.datediff("end", "start") + 1)
    named = F.coalesce(F.size("product_ids"), F.lit(0)) > 0
    products = tables.products.select("product_id", "category")
    first, last = (_bin(F.lit(found[k]).cast("date")) for k in ("first", "last"))
    calendar = products.select("*", F.explode(F.sequence(first, last)).alias("_bin"))
    every = sized.where(~named).withColumn("_bin", _bin("start")).join(calendar, "_bin")
    some = sized.where(named).withColumn("product_id", F.explode(F.array_distinct("product_ids"))).join(products, "product_id")
    columns = ["window_id", "period", "days", "product_id", "category"]
    return every.select(*columns).unionAll(some.select(*columns))


def query_traffic(tables: Tables, windows: DataFrame, include_missing: bool = True) -> DataFrame:
    """Traffic by window and product over every day of the window; a day without a row counts as missing. A product and
    window with a repeated day is left out. Days are added up once, before they meet the windows."""
    seen = ~F.col("is_missing")
    metrics = ("impressions", "clicks", "visits")
    daily = tables.traffic.groupBy("product_id", "date").agg(F.count("*").alias("rows"), F.count_if(seen).alias("seen"), *[F.sum(F.when(seen, F.col(m))).alias(m) for m in metrics])
    held = within(daily, "date", windows).groupBy("window_id", "period", "product_id")
    sums = held.agg(F.count("*").alias("there"), F.sum("rows").alias("rows"), F.sum("seen").alias("seen"), *[F.sum(m).alias(m) for m in metrics])
    joined = _asked(tables, windows).join(sums, ["window_id", "period", "product_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    missing = zero("rows") - zero("seen") + F.col("days") - zero("there")
    out = joined.where(zero("rows") == zero("there")).select("window_id", "period", "product_id", "category", *[zero(m).alias(m) for m in metrics], zero("seen").alias("observed_days"), missing.cast("long").alias("missing_days"))
    return out if include_missing else out.where("missing_days = 0")


def query_marketing(tables: Tables, windows: DataFrame) -> DataFrame:
    held = within(tables.marketing, "date", windows).join(tables.products.select("product_id", "category"), "product_id")
    return held.groupBy("window_id", "period", "product_id", "category", "campaign_id").agg(F.sum("spend").cast("double").alias("spend"))


RUN = {"query_sales": query_sales, "query_traffic": query_traffic, "query_marketing": query_marketing}


def sums(results: dict[str, DataFrame], keys: list[str]) -> list[DataFrame]:
    """For each result by name, a row for each of ``keys`` with the sums of either period and the number of rows."""
    parts = []
    for tool, rows in results.items():
        # money is summed as decimals, so the order of rows can't change a total
        exact = {s: F.col(s).cast("decimal(28,6)") if s in ("gmv", "spend") else F.col(s) for s in derive.SUMS[tool]}
        values = [F.sum(F.when(F.col("period") == p, x)).cast("double" if s in ("gmv", "spend") else "long").alias(f"{p}_{s}") for s, x in exact.items() for p in PERIODS]
        parts.append(rows.groupBy(*keys).agg(F.count("*").alias(f"{tool}_rows"), *values))
    return parts


def _days(windows: DataFrame) -> DataFrame:
    return windows.groupBy("window_id").agg(*[F.max(F.when(F.col("period") == p, F.datediff("end", "start") + 1)).alias(f"{p}_days") for p in PERIODS])


def completeness(traffic: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """For each of ``keys``, whether each of its products, in either period, was observed on all days of a period."""
    per_product = traffic.groupBy(*dict.fromkeys([*keys, "product_id"])).agg(*[F.sum(F.when(F.col("period") == p, F.col("observed_days"))).alias(p) for p in PERIODS])
    return per_product.join(_days(windows), "window_id").groupBy(*keys).agg(*[F.bool_and(F.coalesce(F.col(p) == F.col(f"{p}_days"), F.lit(False))).alias(f"{p}_complete") for p in PERIODS])


def formulas_over(joined: DataFrame) -> tuple[DataFrame, dict]:
    """``joined`` sums with zeros for what a result lacks and nulls for results that are not there, and the metrics over it."""
    have = set(joined.columns)
    others = [c for c in joined.columns if not any(c == f"{p}_{s}" for names in derive.SUMS.values() for s in names for p in PERIODS)]
    cells = [(F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(None).cast("double")).alias(c) for names in derive.SUMS.values() for s in names for p in PERIODS for c in [f"{p}_{s}"]]
    complete = {p: F.coalesce(F.col(f"{p}_complete"), F.lit(False)) if f"{p}_complete" in have else F.lit(True) for p in PERIODS}
    return joined.select(*others, *cells), derive.formulas(complete)


def calculate_metrics(windows: DataFrame, results: dict[str, DataFrame], metrics, group_by=()) -> DataFrame:
    """``window_id``, ``group_by``, ``metrics`` for each window pair, from results of the queries above by name. Without
    groups each window has one row, whatever the results hold."""
    group_by, metrics = list(group_by), list(metrics)
    needed = sorted(frozenset().union(*[derive.NEEDS[m] for m in metrics]))
    if missing := [t for t in needed if t not in results]:
        raise ValueError(f"results of {missing} are needed")
    if "evidence_value" in metrics and group_by != ["product_id"]:
        raise ValueError("evidence_value is defined by product only")
    keys = ["window_id", *group_by]
    parts = sums({t: results[t] for t in needed}, keys)
    if not group_by:
        parts = [windows.select("window_id").distinct(), *parts]
    joined = reduce(lambda a, b: a.join(b, keys, "full" if group_by else "left"), parts)
    if "query_traffic" in needed:
        joined = joined.join(completeness(results["query_traffic"], windows, keys), keys, "left")
    row, by_name = formulas_over(joined)
    return row.select(*keys, *[by_name[m].alias(m) for m in metrics])
