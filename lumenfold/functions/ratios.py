"""Column expressions for ratios that keep missing values apart from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(value: Column | str) -> Column:
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom as double; null where either is null or not finite, or bottom is 0."""
    return F.try_divide(_finite(top), _finite(bottom))


def change_rate(current: Column | str, previous: Column | str) -> Column:
    """(current - previous) / previous; null where it can't be told."""
    return ratio(_finite(current) - _finite(previous), previous)


def first_match(*branches: tuple[Column, dict[str, Column]]) -> Column:
    """The struct of the first branch whose condition holds, null if none does.

    One list of branches decides a label and all that goes with it, so they can't disagree.
    """
    return F.coalesce(*[F.when(test, F.struct(*[v.alias(k) for k, v in fields.items()])) for test, fields in branches])
