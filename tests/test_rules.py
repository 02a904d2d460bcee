"""Hand-checked snapshot of seven products, and the branches it does not reach."""

from datetime import date, timedelta

import pytest

from lumenfold.operators import rules
from lumenfold.sources.schemas import Tables

AS_OF = date(2026, 3, 1)
# Visits, orders and revenue (previous, current) of each product, then extras.
PRODUCTS = {
    "P001": ((300, 300), (6, 3), (600, 300), {}),
    "P002": ((300, 300), (2, 0), (200, 0), {}),
    "P003": ((300, 290), (3, 2), (300, 200), {"missing": 1}),
    "P004": ((300, 300), (25, 25), (2500, 2500), {"refunds": 3}),
    "P005": ((300, 300), (6, 3), (600, 300), {}),
    "P006": ((0, 0), (0, 0), (0, 0), {"missing": 1}),
    "P007": ((300, 300), (6, 6), (600, 300), {}),
}


def build(spark, products) -> Tables:
    traffic, orders = [], []
    for name, (visits, counts, revenue, extra) in products.items():
        for k, first in enumerate((AS_OF - timedelta(days=59), AS_OF - timedelta(days=29))):
            missing = extra.get("missing", 0) if k else 0
            seen = 30 - missing
            for day in range(30):
                gone = day >= seen
                share = None if gone else visits[k] // seen + (day < visits[k] % seen)
                traffic.append((first + timedelta(days=day), name, share, gone))
            for n in range(counts[k]):
                refunded = bool(k) and n < extra.get("refunds", 0)
                orders.append((f"{name}-{k}-{n}", name, first + timedelta(days=n % 30), revenue[k] / counts[k], refunded))
    return Tables(
        spark.createDataFrame([(p,) for p in products], "product_id string"),
        spark.createDataFrame([], "customer_id string"),
        spark.createDataFrame(traffic, "date date, product_id string, visits bigint, is_missing boolean"),
        spark.createDataFrame([], "date date, product_id string, campaign_id string, spend decimal(18,2)"),
        spark.createDataFrame(orders, "order_id string, product_id string, order_date date, revenue double, is_refund boolean"),
    )


@pytest.fixture(scope="module")
def tables(spark):
    return build(spark, PRODUCTS)


def test_gmv_change(tables):
    row = rules.gmv_change(tables).first()
    assert (row.previous_gmv, row.current_gmv, row.previous_orders, row.current_orders) == (4800, 3600, 48, 39)
    assert row.gmv_change_rate == pytest.approx(-0.25) and row.aov_change_rate == pytest.approx(-0.076923, abs=1e-6)


def test_product_anomalies(tables):
    assert [(r.product_id, r.anomaly_type) for r in rules.product_anomalies(tables).collect()] == [
        ("P001", "conversion_drop"), ("P003", "missing_traffic"), ("P004", "high_refund"), ("P005", "conversion_drop"), ("P006", "missing_traffic"), ("P007", "sales_drop"),
    ]


def test_conversion_decline(tables):
    rows = rules.conversion_decline(tables).collect()
    assert [r.product_id for r in rows] == ["P001", "P005", "P002"]
    assert [r.cvr_change for r in rows] == pytest.approx([-0.01, -0.01, -0.006667], abs=1e-6)


def test_products_to_watch(tables):
    assert [(r.product_id, r.watch_reason) for r in rules.products_to_watch(tables).collect()] == [
        ("P003", "data_quality_review"), ("P006", "data_quality_review"), ("P004", "refund_risk"), ("P001", "conversion_decline"), ("P005", "conversion_decline"), ("P002", "gmv_decline"), ("P007", "gmv_decline"),
    ]


def test_next_week_priorities(tables):
    rows = rules.next_week_priorities(tables).collect()
    assert [(r.product_id, r.priority_reason) for r in rows] == [
        ("P003", "repair_data_quality"), ("P006", "repair_data_quality"), ("P004", "investigate_refunds"), ("P001", "recover_conversion"), ("P005", "recover_conversion"),
    ]
    assert [r.evidence_value for r in rows] == pytest.approx([29.0, 29.0, 0.12, -0.01, -0.01])


def test_other_branches_and_limits(spark):
    more = {f"P{k:03d}": ((300, 300), (6, 3), (600, 300), {}) for k in range(20, 34)}
    more |= {"P001": ((300, 150), (30, 15), (600, 300), {}), "P002": ((300, 150), (30, 15), (600, 600), {}), "P003": ((300, 230), (30, 23), (600, 600), {})}
    found = build(spark, more)
    kinds = {r.product_id: r.anomaly_type for r in rules.product_anomalies(found).collect()}
    assert kinds["P001"] == "multi_factor_drop" and kinds["P002"] == "traffic_drop" and "P003" not in kinds
    assert rules.conversion_decline(found).count() == rules.products_to_watch(found).count() == 10
    assert "recover_traffic" in {r.priority_reason for r in rules.next_week_priorities(build(spark, {k: more[k] for k in ("P003",)})).collect()}
