from datetime import date
from decimal import Decimal

import pytest

from lumenfold.operators import derive, kpis, lookups, quality
from lumenfold.operators.windows import Windows
from lumenfold.sources.schemas import SCHEMAS, Tables

W = Windows(date(2026, 4, 1), date(2026, 4, 3), date(2026, 3, 29), date(2026, 3, 31))


@pytest.fixture(scope="module")
def tables(spark):
    day = lambda m, d: date(2026, m, d)
    days = [day(3, 29), day(3, 30), day(3, 31), day(4, 1), day(4, 2)]
    money = lambda x: Decimal(x).quantize(Decimal("0.01"))
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return Tables(
        make("products", [("P001", "One", "home", money(20), money(10), day(1, 1))]),
        make("customers", [("C0001", True, "north", "search")]),
        make("traffic", [(d, "P001", 100, 10, 12, False) for d in days]),
        make("marketing", [(days[0], "P001", "M001", money(3)), (days[1], "P001", "M002", money(12)), (days[3], "P001", "M001", money(10)), (days[4], "P001", "M001", money(20)), (days[4], "P001", "M002", money(11))]),
        make("orders", [("O20260401-P001-000001", "P001", "C0001", days[3], 2, money(20), money(40), False, "paid"), ("O20260402-P001-000001", "P001", "C0001", days[4], 1, money(20), money(20), True, "refunded"), ("O20260330-P001-000001", "P001", "C0001", days[1], 1, money(20), money(20), False, "paid"), ("O20260330-P001-000002", "P001", "C9999", days[1], 1, money(20), money(20), False, "paid")]),
    )


def test_implicit_missing_day(tables):
    rows = {r.period: r for r in lookups.query_traffic(tables, W).collect()}
    assert (rows["current"].observed_days, rows["current"].missing_days, rows["current"].impressions, rows["current"].visits) == (2, 1, 200, 24)
    assert (rows["previous"].observed_days, rows["previous"].missing_days) == (3, 0)
    assert [r.period for r in lookups.query_traffic(tables, W, include_missing=False).collect()] == ["previous"]


def test_repeated_day_drops_the_group(tables):
    twice = Tables(tables.products, tables.customers, tables.traffic.unionAll(tables.traffic.where("date = '2026-04-01'")), tables.marketing, tables.orders)
    assert [r.period for r in lookups.query_traffic(twice, W).collect()] == ["previous"]


def test_marketing_by_campaign(tables):
    assert [(r.period, r.campaign_id, r.spend) for r in lookups.query_marketing(tables, W).collect()] == [("current", "M001", 30), ("current", "M002", 11), ("previous", "M001", 3), ("previous", "M002", 12)]


def test_sales(tables):
    rows = lookups.query_sales(tables, W).collect()
    assert [(r.period, r.gmv, r.orders, r.units, r.refund_orders) for r in rows] == [("current", 60, 2, 3, 1), ("previous", 20, 1, 1, 0)]
    assert lookups.query_sales(tables, W, include_refunds=False).first().gmv == 40


def test_overlapping_windows_count_twice(tables):
    same = Windows(W.start, W.end, W.start, W.end)
    assert [r.gmv for r in lookups.query_sales(tables, same).collect()] == [60, 60]


@pytest.mark.parametrize("ids", [["P1"], ["P001", "P001"]])
def test_bad_ids(tables, ids):
    with pytest.raises(ValueError):
        lookups.query_sales(tables, W, ids)


def test_windows_are_checked():
    with pytest.raises(ValueError):
        Windows(date(2026, 1, 2), date(2026, 1, 1), date(2026, 1, 1), date(2026, 1, 1))
    with pytest.raises(ValueError):
        Windows(date(2024, 1, 1), date(2026, 1, 1), date(2026, 1, 1), date(2026, 1, 1))


def executions(spark, observed=(3, 3)):
    sales = spark.createDataFrame([("current", "P001", "home", "n", "s", 120.0, 3, 3, 1), ("previous", "P001", "home", "n", "s", 100.0, 2, 2, 0)], "period string, product_id string, category string, region string, channel string, gmv double, orders bigint, units bigint, refund_orders bigint")
    traffic = spark.createDataFrame([("current", "P001", "home", 1000, 100, 80, observed[0], 0), ("previous", "P001", "home", 800, 80, 50, observed[1], 0)], "period string, product_id string, category string, impressions bigint, clicks bigint, visits bigint, observed_days bigint, missing_days bigint")
    spend = spark.createDataFrame([("current", "P001", "home", "M001", 40.0), ("previous", "P001", "home", "M001", 25.0)], "period string, product_id string, category string, campaign_id string, spend double")
    return [derive.Execution(n, W, r) for n, r in (("query_sales", sales), ("query_traffic", traffic), ("query_marketing", spend))]


def test_derived_metrics(spark):
    row = derive.calculate_metrics(executions(spark), list(derive.METRICS), ["product_id"]).first()
    assert (row.gmv_change_rate, row.current_aov, row.aov_change_rate) == pytest.approx((0.2, 40, -0.2))
    assert (row.current_cvr, row.previous_cvr) == pytest.approx((3 / 80, 2 / 50))
    assert row.refund_rate == row.evidence_value == pytest.approx(1 / 3) and row.current_roas == 3


def test_incomplete_period_has_no_cvr(spark):
    row = derive.calculate_metrics(executions(spark, (2, 3)), ["current_cvr", "previous_cvr", "evidence_value", "current_ctr"], ["product_id"]).first()
    assert row.current_cvr is None and row.previous_cvr == 0.04 and row.evidence_value == 2 and row.current_ctr == 0.1


def test_no_groups_is_one_row_even_when_empty(spark):
    empty = [derive.Execution(e.tool, W, e.rows.where("false")) for e in executions(spark)]
    rows = derive.calculate_metrics(empty, ["current_gmv", "gmv_change_rate", "current_cvr"]).collect()
    assert len(rows) == 1 and rows[0].current_gmv == 0 and rows[0].gmv_change_rate is None and rows[0].current_cvr is None


def test_preconditions(spark):
    some = executions(spark)
    for metrics, groups, given in (
        (["evidence_value"], [], some),
        (["current_gmv"], ["product_id"], []),
        (["current_gmv"], ["product_id"], [some[0], some[0]]),
        (["current_visits"], ["region"], some),
        ([], [], some),
        (["current_gmv"], [], [derive.Execution("query_sales", W, some[0].rows, include_refunds=False)]),
        (["current_gmv"], [], [derive.Execution("query_sales", W, some[0].rows.unionAll(some[0].rows))]),
        (["current_cvr"], [], [some[0], derive.Execution("query_traffic", Windows.latest(date(2026, 1, 31)), some[1].rows)]),
    ):
        with pytest.raises(ValueError):
            derive.calculate_metrics(given, metrics, groups)


def test_daily_kpis_and_hand_check(tables, spark):
    day = {r.date: r for r in kpis.daily_kpis(tables).collect()}[date(2026, 4, 2)]
    assert day["GMV"] == 20 and day["Refund Rate"] == 1 and day["ROAS"] == pytest.approx(20 / 31) and day["CTR"] == 0.1
    orders = spark.createDataFrame([("a", 100.0, False, "paid"), ("b", 200.0, True, "refunded"), ("c", 9.0, False, "open")], "order_id string, revenue double, is_refund boolean, status string")
    assert tuple(kpis.hand_check(orders, 1000, 100, 50, 75).first()) == pytest.approx((300, 2, 150, 0.1, 0.04, 0.5, 4))


def test_quality(tables):
    failed = {r.check: r.failed for r in quality.report(tables).collect() if r.failed}
    assert failed == {"reference:orders.customer_id": 1, "grain:marketing": 1}
