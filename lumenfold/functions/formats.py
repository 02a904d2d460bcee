"""Answer formats: money, counts and rates, rounded half up; a missing value is a phrase, never a zero."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed phrase shown for a value that the data can't give.
NO_DATA = "数据不足"


def money(value: Column) -> Column:
    rounded = F.round(value.cast("decimal(28,6)"), 2)
    return F.coalesce(F.concat(F.lit("¥"), F.format_number(rounded, 2)), F.lit(NO_DATA))


def count(value: Column) -> Column:
    return F.coalesce(F.format_number(value.cast("long"), 0), F.lit(NO_DATA))


def rate(value: Column) -> Column:
    percent = F.round(value.cast("decimal(28,10)") * 100, 2)
    sign = F.when(percent > 0, "+").otherwise("")
    return F.coalesce(F.concat(sign, percent.cast("decimal(20,2)").cast("string"), F.lit("%")), F.lit(NO_DATA))


def _rounded(value, scale: int = 1) -> Decimal:
    out = (Decimal(str(value)) * scale).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    return abs(out) if out == 0 else out


def money_text(value) -> str:
    return NO_DATA if value is None else f"¥{_rounded(value):,.2f}"


def count_text(value) -> str:
    return NO_DATA if value is None else f"{int(value):,d}"


def rate_text(value) -> str:
    if value is None:
        return NO_DATA
    percent = _rounded(value, 100)
    return f"{'+' if percent > 0 else ''}{percent}%"
