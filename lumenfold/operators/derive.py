"""Derived metrics over the results of the window queries.

Sums first, ratios after: each source is summed by group and period in one pass, the sources meet by group (values that a
source lacks read as 0), and every metric is an expression over that row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import change_rate, ratio
from .rules import LIMITS
from .windows import Windows

GROUPS = ("product_id", "category", "region", "channel")
SUMS = {
    "query_sales": ("gmv", "orders", "units", "refund_orders"),
    "query_traffic": ("impressions", "clicks", "visits", "observed_days", "missing_days"),
    "query_marketing": ("spend",),
}
KEYS = {
    "query_sales": ("period", "product_id", "category", "region", "channel"),
    "query_traffic": ("period", "product_id", "category"),
    "query_marketing": ("period", "product_id", "category", "campaign_id"),
}
PERIODS = ("current", "previous")


@dataclass(frozen=True)
class Execution:
    """A query that has run: its name, its arguments and its rows."""

    tool: str
    windows: Windows
    rows: DataFrame
    product_ids: tuple[str, ...] = ()
    include_refunds: bool = True
    include_missing: bool = True
    dataset_id: str = ""
    source_label: str = ""
    warnings: tuple[str, ...] = field(default=())
    #: Rows come straight from the query, which groups by the key; then they are not searched for repeated keys.
    grouped: bool = False


def formulas(complete: dict[str, Column]) -> dict[str, Column]:
    c = F.col
    out: dict[str, Column] = {}
    for p in PERIODS:
        out |= {f"{p}_{m}": c(f"{p}_{m}") for m in ("gmv", "orders", "impressions", "clicks", "visits", "observed_days", "spend")}
        out[f"{p}_aov"] = ratio(f"{p}_gmv", f"{p}_orders")
        out[f"{p}_ctr"] = ratio(f"{p}_clicks", f"{p}_impressions")
        out[f"{p}_cvr"] = F.when(complete[p], ratio(f"{p}_orders", f"{p}_visits"))
        out[f"{p}_roas"] = ratio(f"{p}_gmv", f"{p}_spend")
    out["gmv_change_rate"] = change_rate("current_gmv", "previous_gmv")
    out["aov_change_rate"] = change_rate(out["current_aov"], out["previous_aov"])
    out["cvr_change"] = out["current_cvr"] - out["previous_cvr"]
    out["cvr_change_rate"] = change_rate(out["current_cvr"], out["previous_cvr"])
    out["traffic_change_rate"] = change_rate("current_visits", "previous_visits")
    out["current_refund_rate"] = out["refund_rate"] = ratio("current_refund_orders", "current_orders")
    out["evidence_value"] = F.coalesce(
        F.when(~(complete["current"] & complete["previous"]), F.least("current_observed_days", "previous_observed_days").cast("double")),
        F.when(out["refund_rate"] >= LIMITS.refund, out["refund_rate"]),
        F.when(out["cvr_change"] <= LIMITS.conversion, out["cvr_change"]),
        F.when(out["traffic_change_rate"] <= LIMITS.decline, out["traffic_change_rate"]),
    )
    return out


_S, _T, _M = "query_sales", "query_traffic", "query_marketing"
NEEDS: dict[str, frozenset[str]] = {
    **{f"{p}_{m}": frozenset([_S]) for p in PERIODS for m in ("gmv", "orders", "aov")},
    **{f"{p}_{m}": frozenset([_T]) for p in PERIODS for m in ("impressions", "clicks", "visits", "ctr", "observed_days")},
    **{f"{p}_cvr": frozenset([_S, _T]) for p in PERIODS},
    **{f"{p}_spend": frozenset([_M]) for p in PERIODS},
    **{f"{p}_roas": frozenset([_S, _M]) for p in PERIODS},
    **{m: frozenset([_S]) for m in ("gmv_change_rate", "aov_change_rate", "current_refund_rate", "refund_rate")},
    **{m: frozenset([_S, _T]) for m in ("cvr_change", "cvr_change_rate", "evidence_value")},
    "traffic_change_rate": frozenset([_T]),
}
METRICS = tuple(NEEDS)


def check(metrics, group_by, executions) -> dict[str, Execution]:
    """The one execution of each source that the metrics need, or ValueError."""
    if not metrics or len(set(metrics)) != len(metrics) or set(metrics) - set(METRICS):
        raise ValueError("metrics must be distinct known names, at least one")
    if len(set(group_by)) != len(group_by) or set(group_by) - set(GROUPS):
        raise ValueError("unknown or repeated group")
    if "evidence_value" in metrics and list(group_by) != ["product_id"]:
        raise ValueError("evidence_value is defined by product only")
    needed = sorted(frozenset().union(*[NEEDS[m] for m in metrics]))
    chosen = {}
    for tool in needed:
        found = [e for e in executions if e.tool == tool]
        if len(found) != 1:
            raise ValueError(f"exactly one result of {tool} is needed")
        chosen[tool] = found[0]
    some = list(chosen.values())
    if len({(e.dataset_id, e.source_label) for e in some}) > 1:
        raise ValueError("results come from different data")
    if len({(e.windows, tuple(sorted(e.product_ids))) for e in some}) > 1:
        raise ValueError("results differ in windows or products")
    if not all(e.include_refunds and e.include_missing for e in some):
        raise ValueError("results must hold refunds and missing days")
    for e in some:
        if set(group_by) - set(e.rows.columns):
            raise ValueError(f"{e.tool} has no {sorted(set(group_by) - set(e.rows.columns))}")
        keys = list(KEYS[e.tool])
        if not e.grouped and not e.rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{e.tool} repeats a key")
    return chosen


def calculate_metrics(executions, metrics, group_by=()) -> DataFrame:
    """``group_by`` columns, then ``metrics``, one row a group (one row in all without groups), sorted by group."""
    group_by, metrics = list(group_by), list(metrics)
    chosen = check(metrics, group_by, executions)
    windows = next(iter(chosen.values())).windows
    sums = [s for tool in chosen for s in SUMS[tool]]
    parts = []
    for tool, e in chosen.items():
        # money is summed as decimals, so the order of rows can't change a total
        exact = {s: F.col(s).cast("decimal(28,6)") if s in ("gmv", "spend") else F.col(s) for s in SUMS[tool]}
        values = [F.sum(F.when(F.col("period") == p, x)).cast("double" if s in ("gmv", "spend") else "long").alias(f"{p}_{s}") for s, x in exact.items() for p in PERIODS]
        parts.append(e.rows.groupBy(*group_by).agg(*values))
    if group_by:
        joined = reduce(lambda a, b: a.join(b, group_by, "full"), parts)
    else:
        joined = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    full = lambda p: F.lit(True)
    complete = {p: full(p) for p in PERIODS}
    if _T in chosen:
        joined = _with_completeness(joined, chosen[_T], windows, group_by)
        complete = {p: F.coalesce(F.col(f"{p}_complete"), F.lit(False)) for p in PERIODS}
    zeros = [F.coalesce(F.col(f"{p}_{s}"), F.lit(0)).alias(f"{p}_{s}") for s in sums for p in PERIODS]
    row = joined.select(*group_by, *zeros, *[F.col(c) for c in joined.columns if c.endswith("_complete")])
    have = set(row.columns)
    row = row.select("*", *[F.lit(None).cast("double").alias(f"{p}_{s}") for tool in SUMS if tool not in chosen for s in SUMS[tool] for p in PERIODS if f"{p}_{s}" not in have])
    by_name = formulas(complete)
    out = row.select(*group_by, *[by_name[m].alias(m) for m in metrics])
    return out.orderBy(*group_by) if group_by else out


def _with_completeness(joined: DataFrame, traffic: Execution, windows: Windows, group_by: list[str]) -> DataFrame:
    """A period is complete if each product of the group, in either period, was observed on all of its days."""
    per_product = traffic.rows.groupBy(*dict.fromkeys([*group_by, "product_id"])).agg(*[F.sum(F.when(F.col("period") == p, F.col("observed_days"))).alias(p) for p in PERIODS])
    flags = per_product.groupBy(*group_by).agg(*[F.bool_and(F.coalesce(F.col(p) == windows.days(p), F.lit(False))).alias(f"{p}_complete") for p in PERIODS])
    return joined.join(flags, group_by, "left") if group_by else joined.crossJoin(flags)
