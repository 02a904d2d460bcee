"""Synthetic base tables with injected anomalies, generated in parallel and independent of partitioning.

Every fact has a random stream of its own, keyed by seed, field, date, product and sequence, so any partition can make any
product-day. Products and customers are small and made on the driver; traffic, marketing and orders each come from a pass
of ``mapInPandas`` over the product-day grid, whose streams are seeded and drawn from as arrays (``streams``).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import streams
from .schemas import SCHEMAS, Tables

CENT = Decimal("0.01")
#: Fixed values of the model.
CATEGORIES = ("beauty", "food", "home", "apparel")
REGIONS = ("north", "south", "east", "west")
CHANNELS = ("organic", "search", "social", "affiliate")
PRODUCT_NAME = "模拟商品 {:03d}"
QUANTITIES = (1, 1, 1, 2, 2, 3)
NEW_CUSTOMER_SHARE = 0.28
MAX_CTR, MAX_CONVERSION, MAX_REFUND = 0.22, 0.25, 0.65
MULTIPLIERS = {
    "sales_drop": ("aov",),
    "traffic_drop": ("traffic",),
    "conversion_drop": ("conversion",),
    "high_refund": ("refund",),
    "extreme_traffic_spike": ("traffic",),
    "multi_factor_drop": ("traffic", "conversion"),
    "missing_traffic": (),
}
DROPS = {"sales_drop", "traffic_drop", "conversion_drop", "multi_factor_drop"}
RISES = {"high_refund", "extreme_traffic_spike"}
#: What an anomaly changes, where it is not a multiplier.
TOUCHES = {"missing_traffic": ("observation",)}
TRAFFIC = "date date, product_id string, impressions long, clicks long, visits long, is_missing boolean"
MARKETING = "date date, product_id string, campaign_id string, cents long"
ORDERS = "order_id string, product_id string, customer_id string, order_date date, quantity long, cents long, is_refund boolean"


@dataclass(frozen=True)
class Anomaly:
    kind: str
    product_id: str
    first_day: int
    last_day: int
    multiplier: float = 1.0
    name: str = ""


@dataclass(frozen=True)
class Config:
    seed: int
    start: date = date(2026, 1, 1)
    days: int = 120
    products: int = 40
    customers: int = 300
    anomalies: tuple[Anomaly, ...] = field(default=())
    categories: tuple[str, ...] = CATEGORIES
    regions: tuple[str, ...] = REGIONS
    channels: tuple[str, ...] = CHANNELS

    def __post_init__(self):
        if not 0 <= self.seed < 1 << 32 or not 60 <= self.days <= 366 or not 7 <= self.products <= 999 or not 20 <= self.customers <= 9999:
            raise ValueError("configuration out of range")
        for names, most in ((self.categories, self.products), (self.regions, self.customers), (self.channels, self.customers)):
            if not 1 <= len(names) <= most or len(set(names)) != len(names) or not all(n.strip() for n in names):
                raise ValueError(f"dimension values must be distinct, not blank, and at most {most}: {names}")
        known = [a.name for a in self.anomalies if a.name]
        if len(set(known)) != len(known):
            raise ValueError("anomaly names repeat")
        for k, a in enumerate(self.anomalies):
            if a.kind not in MULTIPLIERS or not 0 <= a.first_day <= a.last_day < self.days or not 0 < a.multiplier <= 10:
                raise ValueError(f"bad anomaly {a}")
            if (a.kind in DROPS and a.multiplier >= 1) or (a.kind in RISES and a.multiplier <= 1) or (a.kind == "missing_traffic" and a.multiplier != 1):
                raise ValueError(f"the multiplier of {a} contradicts its kind")
            if not re.fullmatch("P[0-9]{3}", a.product_id) or not 1 <= int(a.product_id[1:]) <= self.products:
                raise ValueError(f"unknown product {a.product_id}")
            for b in self.anomalies[:k]:
                together = a.product_id == b.product_id and a.first_day <= b.last_day and b.first_day <= a.last_day
                if together and set(TOUCHES.get(a.kind, MULTIPLIERS[a.kind])) & set(TOUCHES.get(b.kind, MULTIPLIERS[b.kind])):
                    raise ValueError(f"{a} overlaps {b} in what it changes")


def stream(seed: int, name: str):
    """The random generator of one fact."""
    import numpy as np

    digest = hashlib.sha256(name.encode()).digest()
    return np.random.default_rng(np.random.SeedSequence([seed, *(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))]))


def _cents(value: Decimal) -> Decimal:
    return value.quantize(CENT, rounding=ROUND_HALF_UP)


def _balanced(seed: int, name: str, values: tuple, n: int) -> list:
    dealt = [values[k % len(values)] for k in range(n)]
    stream(seed, name).shuffle(dealt)
    return dealt


def product_rows(config: Config) -> list[tuple]:
    n = config.products
    draw = lambda field, low, high: stream(config.seed, f"products.{field}").integers(low, high, size=n).tolist()
    columns = zip(draw("price", 30, 500), draw("margin", 2500, 6001), draw("launch_date", 30, 720), _balanced(config.seed, "products.category", config.categories, n))
    return [
        (f"P{k:03d}", PRODUCT_NAME.format(k), kind, Decimal(price).quantize(CENT), _cents(Decimal(price) * (1 - Decimal(margin) / 10_000)), config.start - timedelta(days=age))
        for k, (price, margin, age, kind) in enumerate(columns, 1)
    ]


def customer_rows(config: Config) -> list[tuple]:
    n = config.customers
    new = stream(config.seed, "customers.is_new_customer").random(n) < NEW_CUSTOMER_SHARE
    places = zip(_balanced(config.seed, "customers.region", config.regions, n), _balanced(config.seed, "customers.channel", config.channels, n))
    return [(f"C{k:04d}", bool(new[k - 1]), region, channel) for k, (region, channel) in enumerate(places, 1)]


def effects(config: Config, product_id: str, day: int) -> dict[str, float]:
    """Product of the multipliers that hold on a day, and whether its traffic is missing."""
    out = {"traffic": 1.0, "conversion": 1.0, "refund": 1.0, "aov": 1.0, "missing": 0.0}
    for a in config.anomalies:
        if a.product_id == product_id and a.first_day <= day <= a.last_day:
            for name in MULTIPLIERS[a.kind]:
                out[name] *= a.multiplier
            if a.kind == "missing_traffic":
                out["missing"] = 1.0
    return out


def _visits(config: Config, days: list[tuple[int, str]]):
    """impressions, clicks and visits of each day and product, their stream keys and effects."""
    keys = [f"{(config.start + timedelta(days=day)).isoformat()}|{product_id}" for day, product_id in days]
    held = [effects(config, product_id, day) for day, product_id in days]
    of = lambda field: streams.generators(config.seed, [f"{field}|{k}" for k in keys])
    numbers, weekend = [int(p[1:]) for _, p in days], [(config.start + timedelta(days=d)).weekday() >= 5 for d, _ in days]
    expected = [(850 + 12 * n) * (1.12 if late else 1.0) * (1 + 0.0008 * day) * effect["traffic"] for n, late, (day, _), effect in zip(numbers, weekend, days, held)]
    impressions = [int(g.poisson(x)) for g, x in zip(of("traffic.impressions"), expected)]
    clicks = [int(g.binomial(x, min(MAX_CTR, 0.07 + (n % 5) * 0.01))) for g, x, n in zip(of("traffic.clicks"), impressions, numbers)]
    visits = [c + int(g.poisson(max(4, c * 0.12))) for g, c in zip(of("traffic.visits"), clicks)]
    return impressions, clicks, visits, keys, held


def traffic_rows(config: Config, days: list[tuple[int, str]]) -> list[tuple]:
    impressions, clicks, visits, _, held = _visits(config, days)
    hide = lambda x, effect: None if effect["missing"] else x
    return [(config.start + timedelta(days=d), p, hide(i, e), hide(c, e), hide(v, e), bool(e["missing"])) for (d, p), i, c, v, e in zip(days, impressions, clicks, visits, held)]


def marketing_rows(config: Config, days: list[tuple[int, str]]) -> list[tuple]:
    """Spend in cents, rounded half up: a rate of 0.012 and 0.0005 more on each day of a week."""
    impressions = _visits(config, days)[0]
    return [(config.start + timedelta(days=d), p, f"M{p[1:]}", (i * (24 + d % 7) + 10) // 20) for (d, p), i in zip(days, impressions)]


def order_rows(config: Config, days: list[tuple[int, str]], prices: list[Decimal]) -> list[tuple]:
    """Orders with their unit price in cents."""
    import numpy as np

    _, _, visits, keys, held = _visits(config, days)
    numbers = [int(p[1:]) for _, p in days]
    generators = streams.generators(config.seed, [f"orders.count|{k}" for k in keys])
    counts = [int(g.binomial(v, min(MAX_CONVERSION, (0.035 + (n % 4) * 0.008) * e["conversion"]))) for g, v, n, e in zip(generators, visits, numbers, held)]
    refund = np.repeat([min(MAX_REFUND, (0.035 + (n % 3) * 0.01) * e["refund"]) for n, e in zip(numbers, held)], counts)
    cents = [int(_cents(price * Decimal(str(e["aov"]))).scaleb(2)) for price, e in zip(prices, held)]
    of = lambda field: [f"{field}|{key}|{k}" for key, count in zip(keys, counts) for k in range(1, count + 1)]
    customers = streams.below(config.seed, of("orders.customer"), config.customers) + 1
    quantities = np.array(QUANTITIES)[streams.below(config.seed, of("orders.quantity"), len(QUANTITIES))]
    refunded = streams.uniform(config.seed, of("orders.refund")) < refund
    out = zip(((d, p, c, k) for (d, p), c, count in zip(days, cents, counts) for k in range(1, count + 1)), customers.tolist(), quantities.tolist(), refunded.tolist())
    dates = {d: config.start + timedelta(days=d) for d, _ in days}
    return [(f"O{dates[d]:%Y%m%d}-{p}-{k:06d}", p, f"C{customer:04d}", dates[d], quantity, c, back) for (d, p, c, k), customer, quantity, back in out]


def generate(spark: SparkSession, config: Config) -> Tables:
    products = spark.createDataFrame(product_rows(config), SCHEMAS["products"])
    customers = spark.createDataFrame(customer_rows(config), SCHEMAS["customers"])

    grid = spark.range(config.days).withColumnRenamed("id", "day").crossJoin(F.broadcast(products.select("product_id", "price")))  # at most 999 products
    grid = grid.repartition("day", "product_id")

    def make(rows_of, schema):
        names = [part.split()[0] for part in schema.split(", ")]

        def run(batches):
            import pandas as pd

            for batch in batches:
                days = list(zip(batch["day"].tolist(), batch["product_id"].tolist()))
                for at in range(0, len(days), 1000):
                    more = (batch["price"].tolist()[at : at + 1000],) if rows_of is order_rows else ()
                    rows = rows_of(config, days[at : at + 1000], *more)
                    yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

        return grid.mapInPandas(run, schema)

    money = lambda cents: F.expr(f"cast(cast({cents} as decimal(20,0)) * 0.01BD as decimal(18,2))")
    status = F.when(F.col("is_refund"), "refunded").otherwise("paid").alias("status")
    return Tables(
        products,
        customers,
        make(traffic_rows, TRAFFIC),
        make(marketing_rows, MARKETING).select("date", "product_id", "campaign_id", money("cents").alias("spend")),
        make(order_rows, ORDERS).select("order_id", "product_id", "customer_id", "order_date", "quantity", money("cents").alias("unit_price"), money("cents * quantity").alias("revenue"), "is_refund", status),
    )


def _preset(seed: int, *rows: tuple) -> Config:
    return Config(seed, anomalies=tuple(Anomaly(kind, f"P{n:03d}", a, b, m) for kind, n, a, b, m in rows))


#: The two published data sets.
DEVELOPMENT = _preset(
    20260928, ("sales_drop", 1, 90, 119, 0.55), ("traffic_drop", 2, 90, 119, 0.55), ("conversion_drop", 3, 90, 119, 0.50), ("high_refund", 4, 90, 119, 4.0), ("missing_traffic", 5, 105, 110, 1.0), ("extreme_traffic_spike", 6, 112, 112, 4.0), ("multi_factor_drop", 7, 90, 119, 0.70)
)
VALIDATION = _preset(
    20261029, ("sales_drop", 2, 90, 119, 0.58), ("traffic_drop", 1, 90, 119, 0.52), ("conversion_drop", 4, 90, 119, 0.48), ("high_refund", 3, 90, 119, 4.2), ("missing_traffic", 5, 104, 111, 1.0), ("extreme_traffic_spike", 7, 113, 113, 4.3), ("multi_factor_drop", 6, 90, 119, 0.68)
)
