"""Schemas of the five base tables and the record types that go with them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "money": T.DecimalType(18, 2)}


def _schema(text: str) -> T.StructType:
    """A schema from "name type, ..." (no Spark session is needed to import this module)."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


SCHEMAS: dict[str, T.StructType] = {
    "products": _schema("product_id string, product_name string, category string, price money, cost money, launch_date date"),
    "customers": _schema("customer_id string, is_new_customer boolean, region string, channel string"),
    "traffic": _schema("date date, product_id string, impressions bigint, clicks bigint, visits bigint, is_missing boolean"),
    "marketing": _schema("date date, product_id string, campaign_id string, spend money"),
    "orders": _schema("order_id string, product_id string, customer_id string, order_date date, quantity bigint, unit_price money, revenue money, is_refund boolean, status string"),
}
TABLES = tuple(SCHEMAS)
KEYS = {
    "products": ["product_id"],
    "customers": ["customer_id"],
    "traffic": ["date", "product_id"],
    "marketing": ["date", "product_id", "campaign_id"],
    "orders": ["order_id"],
}


@dataclass(frozen=True)
class Tables:
    """The five base tables as lazy DataFrames."""

    products: DataFrame
    customers: DataFrame
    traffic: DataFrame
    marketing: DataFrame
    orders: DataFrame

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def register(self, spark=None) -> None:
        for name, df in self.items():
            df.createOrReplaceTempView(name)


def conform(name: str, df: DataFrame) -> DataFrame:
    """Cast to the table's declared types (traffic counts may be stored as doubles); unknown columns are refused."""
    want = SCHEMAS[name]
    if set(df.columns) != set(want.names):
        raise ValueError(f"{name}: columns {sorted(df.columns)} differ from {sorted(want.names)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want])


def read(spark, folder: str) -> Tables:
    """The five tables from ``folder/<name>.parquet``."""
    return Tables(**{n: conform(n, spark.read.parquet(f"{folder}/{n}.parquet")) for n in TABLES})
