"""Checks of the five base tables: row rules, keys, references, daily grain, funnel and revenue.

Each check is a DataFrame of what breaks it; ``report`` counts them. Nothing is collected but the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import KEYS, TABLES, Tables

#: Fixed patterns of the identifiers.
PATTERNS = {"product_id": "^P[0-9]{3}$", "customer_id": "^C[0-9]{4}$", "campaign_id": "^M[0-9]{3}$", "order_id": "^O[0-9]{8}-P[0-9]{3}-[0-9]{6}$"}
REFERENCES = [("traffic", "product_id", "products"), ("marketing", "product_id", "products"), ("orders", "product_id", "products"), ("orders", "customer_id", "customers")]


def row_rules(name: str, *, identifiers: bool = True) -> dict[str, str]:
    """Rule name to the SQL condition that each row must meet."""
    metrics = ("impressions", "clicks", "visits")
    rules = {
        "products": {"name": "char_length(product_name) > 0", "category": "char_length(category) > 0", "price": "price > 0", "cost": "cost > 0 and cost < price", "launch_date": "launch_date is not null"},
        "customers": {"is_new_customer": "is_new_customer is not null", "region": "char_length(region) > 0", "channel": "char_length(channel) > 0"},
        "traffic": {
            "date": "date is not null",
            "missing": "is_missing is not null and " + " and ".join(f"({m} is null) = is_missing" for m in metrics),
            "sign": " and ".join(f"coalesce({m}, 0) >= 0" for m in metrics),
            "funnel": "is_missing or (impressions >= clicks and visits >= clicks)",
        },
        "marketing": {"date": "date is not null", "spend": "spend >= 0"},
        "orders": {
            "order_date": "order_date is not null",
            "quantity": "quantity between 1 and 20",
            "price": "unit_price > 0 and revenue > 0",
            "revenue": "revenue = cast(unit_price * quantity as decimal(18,2))",
            "status": "status in ('paid', 'refunded') and is_refund = (status = 'refunded')",
        },
    }[name]
    if identifiers:
        rules |= {c: f"{c} rlike '{p}'" for c, p in PATTERNS.items() if c in KEYS[name] or (name == "orders" and c != "campaign_id")}
    return rules


#: Columns that a rule is about, where it is not named like its column.
ABOUT = {"name": "product_name", "missing": "is_missing", "sign": "impressions", "funnel": "clicks", "price": "unit_price"}


def table_errors(name: str, df: DataFrame, *, identifiers: bool = True) -> DataFrame:
    """table, key, location (column), type (missing or value_error) and message for each row rule that a row breaks."""
    found = []
    for rule, condition in row_rules(name, identifiers=identifiers).items():
        column = rule if rule in df.columns else ABOUT.get(rule, rule)
        kind = F.when(F.col(column).isNull(), "missing").otherwise("value_error")
        broken = F.struct(F.lit(column).alias("location"), kind.alias("type"), F.lit(condition).alias("message"))
        found.append(F.when(~F.coalesce(F.expr(condition), F.lit(False)), broken))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS[name]])
    return df.select(F.lit(name).alias("table"), key.alias("key"), F.explode(F.array_compact(F.array(*found))).alias("e")).select("table", "key", "e.*")


def row_errors(tables: Tables, *, identifiers: bool = True) -> DataFrame:
    """The errors of all tables."""
    return reduce(DataFrame.unionAll, [table_errors(name, df, identifiers=identifiers) for name, df in tables.items()])


def id_differences(df: DataFrame, key: str, prefix: str, n: int) -> DataFrame:
    """id and problem: ids of 1..n that are absent, ids that are unexpected, and ids that repeat."""
    width = 3 if prefix == "P" else 4
    want = df.sparkSession.range(1, n + 1).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), width, "0")).alias("id"))
    have = df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    both = want.withColumn("wanted", F.lit(True)).join(have, "id", "full")
    problem = F.when(F.col("n").isNull(), "absent").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("id", problem.alias("problem")).where("problem is not null")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def broken_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is not null and not in the parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def grain_gaps(tables: Tables, facts: DataFrame) -> DataFrame:
    """product_id, date and problem: days of the table's span that a product lacks, and days of unknown products."""
    span = facts.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = tables.products.select("product_id").crossJoin(F.broadcast(span)).where("a is not null").select("product_id", F.explode(F.sequence("a", "b")).alias("date"))
    have = facts.select("product_id", "date").distinct()
    return grid.join(have, ["product_id", "date"], "left_anti").withColumn("problem", F.lit("absent")).unionByName(have.join(grid, ["product_id", "date"], "left_anti").withColumn("problem", F.lit("unexpected")))


def funnel_violations(traffic: DataFrame) -> DataFrame:
    return traffic.where("not is_missing and (impressions < clicks or visits < clicks)").select("date", "product_id", "impressions", "clicks", "visits")


def revenue_violations(orders: DataFrame) -> DataFrame:
    off = F.round("revenue", 2) != F.round(F.col("unit_price") * F.col("quantity"), 2)
    return orders.where(off).select("order_id", "quantity", "unit_price", "revenue")


def report(tables: Tables, *, identifiers: bool = True) -> DataFrame:
    """check and failed (how many cases), in fixed order; each table is scanned once."""
    from . import validation

    return validation.examine(tables, identifiers=identifiers).select("check", "failed")


#: Names of the checks in the order in which they are reported.
NAMES = {
    "products_schema": "schema:products", "customers_schema": "schema:customers", "traffic_schema": "schema:traffic", "marketing_schema": "schema:marketing", "orders_schema": "schema:orders",
    "product_id_unique": "key:products", "customer_id_unique": "key:customers", "traffic_primary_key": "key:traffic", "marketing_primary_key": "key:marketing", "order_id_unique": "key:orders",
    "product_dimension_ids": "ids:products", "customer_dimension_ids": "ids:customers",
    "traffic_product_fk": "reference:traffic.product_id", "marketing_product_fk": "reference:marketing.product_id", "order_product_fk": "reference:orders.product_id", "order_customer_fk": "reference:orders.customer_id",
    "traffic_daily_grain": "grain:traffic", "marketing_daily_grain": "grain:marketing",
    "traffic_funnel_impressions_clicks": "funnel:impressions", "traffic_funnel_clicks_visits": "funnel:visits", "order_revenue_identity": "revenue",
}


def validate(tables: dict[str, DataFrame], products: int, customers: int) -> dict:
    """status, errors (names of failed checks, in order), schema_errors and rows of a data set of so many products and
    customers; without the five tables nothing else is checked."""
    if set(tables) != set(TABLES):
        return {"status": "fail", "errors": ["required_tables"], "schema_errors": [], "rows": {}}
    from . import validation

    whole = Tables(**tables)
    found = validation.sums(whole).collect()[0].asDict()  # one row
    failed = {c: found.get(c) or 0 for c in validation.CHECKS if not c.startswith("grain:")}
    failed |= {f"grain:{n}": validation.gaps(found, n) for n in validation.DAILY} | {f"funnel:{n}": found[n] or 0 for n in ("impressions", "visits")}
    failed["ids:products"] = id_differences(tables["products"], "product_id", "P", products).count()
    failed["ids:customers"] = id_differences(tables["customers"], "customer_id", "C", customers).count()
    errors = [name for name, check in NAMES.items() if failed[check]]
    details = [r.asDict() for n in TABLES if failed[f"schema:{n}"] for r in table_errors(n, tables[n]).orderBy("key", "location").collect()]
    return {"status": "fail" if errors else "pass", "errors": errors, "schema_errors": details, "rows": {n: found[f"rows:{n}"] or 0 for n in TABLES}}
