"""The generator against one fact at a time, and its streams against numpy's generators."""

from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from lumenfold.sources import generate, streams

NAMES = [f"orders.refund|2026-01-01|P{k:03d}|{k}" for k in range(400)]


@pytest.mark.parametrize("seed", [0, 7, 2**32 - 1, 20260928])
def test_streams_equal_numpy(seed):
    one = [generate.stream(seed, n) for n in NAMES]
    assert streams.first(seed, NAMES).tolist() == [int(np.random.Generator(g.bit_generator).integers(0, 2**64, dtype=np.uint64)) for g in one]
    assert streams.uniform(seed, NAMES).tolist() == [generate.stream(seed, n).random() for n in NAMES]
    for n in (1, 6, 300, 2**31 + 1):
        assert streams.below(seed, NAMES, n).tolist() == [int(generate.stream(seed, x).integers(0, n)) for x in NAMES]
    assert [g.poisson(900.5) for g in streams.generators(seed, NAMES)] == [generate.stream(seed, n).poisson(900.5) for n in NAMES]
    assert [g.binomial(120, 0.04) for g in streams.generators(seed, NAMES)] == [generate.stream(seed, n).binomial(120, 0.04) for n in NAMES]
    assert list(streams.generators(seed, [])) == []


def one_day(config, day: int, product_id: str, price: Decimal):
    """Traffic, marketing and orders of a product on a day, a generator for each draw."""
    today, n, effect = config.start + timedelta(days=day), int(product_id[1:]), generate.effects(config, product_id, day)
    of = lambda name, *k: generate.stream(config.seed, "|".join([name, today.isoformat(), product_id, *map(str, k)]))
    cents = lambda x: x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    expected = (850 + 12 * n) * (1.12 if today.weekday() >= 5 else 1.0) * (1 + 0.0008 * day) * effect["traffic"]
    impressions = int(of("traffic.impressions").poisson(expected))
    clicks = int(of("traffic.clicks").binomial(impressions, min(0.22, 0.07 + (n % 5) * 0.01)))
    visits = clicks + int(of("traffic.visits").poisson(max(4, clicks * 0.12)))
    traffic = (today, product_id, *((None,) * 3 if effect["missing"] else (impressions, clicks, visits)), bool(effect["missing"]))
    spend = cents(Decimal(impressions) * (Decimal("0.012") + Decimal(day % 7) * Decimal("0.0005")))
    orders, unit = [], cents(price * Decimal(str(effect["aov"])))
    for k in range(1, 1 + int(of("orders.count").binomial(visits, min(0.25, (0.035 + (n % 4) * 0.008) * effect["conversion"])))):
        customer, quantity = int(of("orders.customer", k).integers(1, config.customers + 1)), int(of("orders.quantity", k).choice([1, 1, 1, 2, 2, 3]))
        back = bool(of("orders.refund", k).random() < min(0.65, (0.035 + (n % 3) * 0.01) * effect["refund"]))
        orders.append((f"O{today:%Y%m%d}-{product_id}-{k:06d}", product_id, f"C{customer:04d}", today, quantity, unit, unit * quantity, back, "refunded" if back else "paid"))
    return traffic, (today, product_id, f"M{n:03d}", spend), orders


def test_tables_equal_one_fact_at_a_time(spark):
    kinds = (("sales_drop", "P001", 3, 20, 0.55), ("traffic_drop", "P002", 0, 59, 0.5), ("missing_traffic", "P003", 5, 9, 1.0), ("high_refund", "P004", 0, 59, 9.0), ("extreme_traffic_spike", "P005", 1, 30, 4.0), ("multi_factor_drop", "P006", 0, 50, 0.7))
    config = generate.Config(5, date(2026, 1, 1), 60, 7, 20, tuple(generate.Anomaly(*k) for k in kinds))
    tables, price = generate.generate(spark, config), {r[0]: r[3] for r in generate.product_rows(config)}
    days = [one_day(config, d, p, price[p]) for d in range(60) for p in price]
    assert sorted(map(tuple, tables.traffic.collect()), key=str) == sorted((t for t, _, _ in days), key=str)
    assert sorted(map(tuple, tables.marketing.collect())) == sorted(m for _, m, _ in days)
    assert sorted(map(tuple, tables.orders.collect())) == sorted(o for _, _, orders in days for o in orders)
    again = generate.generate(spark, config)
    assert sorted(map(tuple, again.orders.collect())) == sorted(map(tuple, tables.orders.collect()))


def test_an_anomaly_changes_its_days_only():
    plain = generate.Config(5, days=60, products=7, customers=20)
    changed = generate.Config(5, days=60, products=7, customers=20, anomalies=(generate.Anomaly("traffic_drop", "P001", 0, 59, 0.5),))
    others, price = [(d, f"P{k:03d}") for d in (0, 30, 59) for k in range(2, 8)], {r[0]: r[3] for r in generate.product_rows(plain)}
    of = lambda config: (generate.traffic_rows(config, others), generate.marketing_rows(config, others), generate.order_rows(config, others, [price[p] for _, p in others]))
    assert of(plain) == of(changed) and generate.traffic_rows(plain, [(3, "P001")]) != generate.traffic_rows(changed, [(3, "P001")])
    with pytest.raises(ValueError):
        generate.Config(5, days=10)
