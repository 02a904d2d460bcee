"""All checks of the five tables in one pass: each table is scanned once, whatever is checked.

Every row becomes a few entries: its own key with what its row breaks, and the keys that it refers to. Entries of all tables
meet by key in one shuffle, combined in each task first, so a key of very many rows is one entry a task. A key that several
rows own is repeated; one that is referred to and owned by none is broken. The keys of daily facts then meet by product
and day, then by product, as sums of keys and not as rows: a product's days against the days of the table are the gaps of the
grain. One row of sums
is left, with the first key that fails each check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import KEYS, TABLES, Tables
from .quality import REFERENCES, row_rules

#: Checks in the order of a report.
CHECKS = (
    *(f"schema:{n}" for n in TABLES),
    *(f"key:{n}" for n in TABLES),
    *(f"reference:{child}.{key}" for child, key, _ in REFERENCES),
    "grain:traffic",
    "grain:marketing",
    "funnel",
    "revenue",
)
DAILY = ("traffic", "marketing")
NULL = "\u0000"
FUNNEL = {"funnel": "not is_missing and (impressions < clicks or visits < clicks)", "impressions": "not is_missing and impressions < clicks", "visits": "not is_missing and visits < clicks"}
REVENUE = "round(revenue, 2) <> round(unit_price * quantity, 2)"
ENTRY = ("owner", "key", "product", "day", "own", "errors", "funnel", "impressions", "visits", "revenue", *(f"from_{c}_{k}" for c, k, _ in REFERENCES))


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in columns])


def _entry(**cells) -> Column:
    zero, none = F.lit(0), F.lit(None)
    kinds = {"owner": "string", "key": "string", "product": "string", "day": "date"}
    return F.struct(*[cells.get(c, none if c in kinds else zero).cast(kinds.get(c, "long")).alias(c) for c in ENTRY])


def _entries(name: str, df: DataFrame, identifiers: bool) -> DataFrame:
    flag = lambda condition: F.coalesce(F.expr(condition), F.lit(False)).cast("long")
    errors = reduce(Column.__add__, [1 - flag(rule) for rule in row_rules(name, identifiers=identifiers).values()])
    own = {"owner": F.lit(name), "key": _key(KEYS[name]), "own": F.lit(1), "errors": errors}
    if name == "products":
        own["product"] = F.col("product_id")
    if name in DAILY:
        own |= {"product": F.col("product_id"), "day": F.col("date")}
    if name == "traffic":
        own |= {c: flag(condition) for c, condition in FUNNEL.items()}
    if name == "orders":
        own["revenue"] = flag(REVENUE)
    refers = [F.when(F.col(key).isNotNull(), _entry(owner=F.lit(parent), key=_key([key]), product=F.col(key) if parent == "products" else F.lit(None), **{f"from_{name}_{key}": F.lit(1)})) for child, key, parent in REFERENCES if child == name]
    return df.select(F.explode(F.array_compact(F.array(_entry(**own), *refers))).alias("e")).select("e.*")


def _add_up(name: str) -> Column:
    how = F.max if name.startswith("to:") else F.min if name.startswith(("first:", "from:", "least:")) else F.sum
    return how(f"`{name}`").alias(name)


def sums(tables: Tables, *, identifiers: bool = True) -> DataFrame:
    """One row with every count and first key."""
    all_entries = reduce(DataFrame.unionAll, [_entries(name, df, identifiers) for name, df in tables.items()])
    counted = ["own", "errors", "funnel", "impressions", "visits", "revenue", *[c for c in ENTRY if c.startswith("from_")]]
    by_key = all_entries.groupBy("owner", "key", "product", "day").agg(*[F.sum(c).alias(c) for c in counted])
    is_of = lambda name: F.col("owner") == name
    cells = []
    for name in TABLES:
        repeated = is_of(name) & (F.col("own") > 1)
        cells += [F.sum(F.when(is_of(name), F.col("own"))).alias(f"rows:{name}"), F.sum(F.when(is_of(name), F.col("errors"))).alias(f"schema:{name}"), F.min(F.when(is_of(name) & (F.col("errors") > 0), F.col("key"))).alias(f"first:schema:{name}")]
        cells += [F.count_if(repeated).alias(f"key:{name}"), F.min(F.when(repeated, F.col("key"))).alias(f"first:key:{name}")]
    for child, key, parent in REFERENCES:
        broken = is_of(parent) & (F.col("own") == 0) & (F.col(f"from_{child}_{key}") > 0)
        cells += [F.sum(F.when(broken, F.col(f"from_{child}_{key}"))).alias(f"reference:{child}.{key}"), F.min(F.when(broken, F.col("key"))).alias(f"first:reference:{child}.{key}")]
    for c in ("funnel", "impressions", "visits", "revenue"):
        cells += [F.sum(c).alias(c), F.min(F.when(F.col(c) > 0, F.col("key"))).alias(f"first:{c}")]
    for name in DAILY:
        there = is_of(name) & (F.col("own") > 0)
        whole = there & F.col("day").isNotNull()
        cells += [F.max(whole.cast("long")).alias(f"days:{name}"), F.max((there & F.col("day").isNull()).cast("long")).alias(f"dateless:{name}"), F.min(F.when(whole, F.col("day"))).alias(f"from:{name}"), F.max(F.when(whole, F.col("day"))).alias(f"to:{name}"), F.min(F.when(there, F.col("key"))).alias(f"least:{name}")]
    by_day = by_key.groupBy("product", "day").agg(F.sum(F.when(is_of("products"), F.col("own"))).alias("times"), *cells)  # a day counts once, whatever its keys
    names = [c for c in by_day.columns if c not in ("product", "day", "times")]
    by_product = by_day.groupBy("product").agg(F.sum("times").alias("times"), *[_add_up(c) for c in names])
    known = (F.coalesce("times", F.lit(0)) > 0) & F.col("product").isNotNull()
    total = [F.sum("times").alias("products")]
    total += [_add_up(c) for c in names if not c.startswith(("days:", "dateless:", "least:"))]
    for name in DAILY:
        days, dateless = F.col(f"days:{name}"), F.col(f"dateless:{name}")
        stray = ~known & (days + dateless > 0)
        # days of products that are known, once for each row of the product; days that belong to none
        total += [F.sum(F.when(known, F.col("times") * days)).alias(f"met:{name}"), F.sum(F.when(known, dateless).otherwise(days + dateless)).alias(f"stray:{name}"), F.min(F.when(stray, F.col(f"least:{name}"))).alias(f"first:grain:{name}")]
    return by_product.agg(*total)


def _grain(name: str) -> Column:
    span = F.datediff(F.col(f"`to:{name}`"), F.col(f"`from:{name}`")) + 1
    absent = F.when(F.col(f"from:{name}").isNotNull(), F.col("products") * span - F.coalesce(F.col(f"met:{name}"), F.lit(0)))
    return F.coalesce(absent, F.lit(0)) + F.coalesce(F.col(f"stray:{name}"), F.lit(0))


def gaps(found: dict, name: str) -> int:
    """The failures of a table's grain from a fetched row of ``sums``."""
    first, last = found[f"from:{name}"], found[f"to:{name}"]
    absent = (found["products"] or 0) * ((last - first).days + 1) - (found[f"met:{name}"] or 0) if first else 0
    return absent + (found[f"stray:{name}"] or 0)


def examine(tables: Tables, *, identifiers: bool = True) -> DataFrame:
    """check, failed (how many cases) and first_key (the smallest key that fails, where a row does), in fixed order."""
    row = sums(tables, identifiers=identifiers)
    cells = []
    for position, check in enumerate(CHECKS):
        failed = _grain(check.partition(":")[2]) if check.startswith("grain:") else F.coalesce(F.col(f"`{check}`"), F.lit(0))
        first = F.regexp_replace(F.col(f"`first:{check}`"), NULL, "")
        cells.append(F.struct(F.lit(position).alias("position"), F.lit(check).alias("check"), failed.cast("long").alias("failed"), first.alias("first_key")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").orderBy("position").select("check", "failed", "first_key")
