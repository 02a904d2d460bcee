"""Validation in one pass against the checks one by one, on sound and on damaged tables."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest

from lumenfold.operators import quality, validation
from lumenfold.sources import schemas
from lumenfold.sources.schemas import KEYS, SCHEMAS, TABLES, Tables

START = date(2026, 1, 1)


def build(spark, seed: int, damage: float) -> Tables:
    """Tables in which each cell is replaced by an odd one, and each row repeated or lost, with a chance of ``damage``."""
    r = random.Random(seed)
    hit = lambda: r.random() < damage
    money = lambda x: Decimal(x).quantize(Decimal("0.01"))
    ids, buyers, days = [f"P{k:03d}" for k in range(1, 7)], [f"C{k:04d}" for k in range(1, 9)], [START + timedelta(days=k) for k in range(8)]
    rows = {
        "products": [(p, "name", "kind", money(20), money(5), START) for p in ids],
        "customers": [(c, True, "north", "search") for c in buyers],
        "traffic": [(d, p, 100, 10, 12, False) if (k + len(p)) % 7 else (d, p, None, None, None, True) for k, d in enumerate(days) for p in ids],
        "marketing": [(d, p, f"M00{c}", money(3)) for d in days for p in ids for c in (1, 2)],
        "orders": [(f"O{d:%Y%m%d}-{p}-{k:06d}", p, buyers[(k + int(p[1:])) % 8], d, 2, money(20), money(40), False, "paid") for d in days for p in ids for k in (1, 2)],
    }
    odd = {"string": [None, "", "P999", "C9999"], "bigint": [None, -1, 0, 99], "boolean": [None, True], "date": [None, START + timedelta(days=20)], "decimal(18,2)": [None, money(0), money(-1), money(77)]}
    out = {}
    for name, schema in SCHEMAS.items():
        kinds = [f.dataType.simpleString() for f in schema]
        changed = [tuple(r.choice(odd[kind]) if hit() else v for v, kind in zip(row, kinds)) for row in rows[name] if not hit()]
        changed += [row for row in changed if hit()]
        out[name] = spark.createDataFrame(changed, schema).repartition(2)
    return Tables(**out)


def one_by_one(tables: Tables) -> dict:
    t = dict(tables.items())
    out = {f"schema:{n}": quality.table_errors(n, t[n]).count() for n in TABLES}
    out |= {f"key:{n}": quality.duplicate_keys(t[n], KEYS[n]).count() for n in TABLES}
    out |= {f"reference:{c}.{k}": quality.broken_references(t[c], t[p], k).count() for c, k, p in quality.REFERENCES}
    out |= {f"grain:{n}": quality.grain_gaps(tables, t[n]).count() for n in ("traffic", "marketing")}
    return out | {"funnel": quality.funnel_violations(t["traffic"]).count(), "revenue": quality.revenue_violations(t["orders"]).count()}


@pytest.mark.parametrize(("seed", "damage"), [(1, 0.0), (2, 0.02), (3, 0.1), (4, 0.4), (5, 1.0)])
def test_one_pass_equals_the_checks_one_by_one(spark, seed, damage):
    tables = build(spark, seed, damage)
    got = validation.examine(tables).collect()
    assert [r.check for r in got] == list(validation.CHECKS)
    assert {r.check: r.failed for r in got} == one_by_one(tables)
    assert any(r.failed for r in got) == (0 < damage < 1) and [r.check for r in quality.report(tables).collect()] == list(validation.CHECKS)
    found = validation.sums(tables).first().asDict()
    assert [found[f"rows:{n}"] or 0 for n in TABLES] == [df.count() for _, df in tables.items()]
    assert [validation.gaps(found, n) for n in validation.DAILY] == [{r.check: r.failed for r in got}[f"grain:{n}"] for n in validation.DAILY]


def test_first_keys(spark):
    tables = build(spark, 3, 0.1)
    first = {r.check: r.first_key for r in validation.examine(tables).collect() if r.failed}
    errors = [e.key for e in quality.table_errors("orders", tables.orders).collect() if "|" not in e.key and e.key]
    assert first["schema:orders"] in ("", *errors) and first["schema:orders"] <= min(errors)
    missing = sorted(r.product_id for r in quality.broken_references(tables.orders, tables.products, "product_id").collect())
    assert first["reference:orders.product_id"] == missing[0]
    assert all(k is not None for c, k in first.items() if not c.startswith("grain:"))


def test_each_table_is_scanned_once(spark, tmp_path):
    for name, df in build(spark, 1, 0.0).items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stored = schemas.read(spark, str(tmp_path))
    report = quality.report(stored)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == len(TABLES) and "NestedLoop" not in plan and "Cartesian" not in plan
    assert report.agg({"failed": "sum"}).first()[0] == 0


def test_validate_counts_rows_and_names_checks(spark):
    tables = build(spark, 1, 0.0)
    found = quality.validate(dict(tables.items()), 6, 8)
    assert (found["status"], found["errors"], found["rows"]) == ("pass", [], {"products": 6, "customers": 8, "traffic": 48, "marketing": 96, "orders": 96})
    broken = dict(tables.items()) | {"traffic": tables.traffic.where("product_id <> 'P002'")}
    found = quality.validate(broken, 6, 8)
    assert found["errors"] == ["traffic_daily_grain"] and found["rows"]["traffic"] == 40
    empty = {n: df.where("false") for n, df in tables.items()}
    assert quality.validate(empty, 0, 0)["rows"] == dict.fromkeys(TABLES, 0)
