"""Two closed date windows that are compared with each other."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DAYS = 366


@dataclass(frozen=True)
class Windows:
    start: date
    end: date
    comparison_start: date
    comparison_end: date

    def __post_init__(self):
        for a, b in ((self.start, self.end), (self.comparison_start, self.comparison_end)):
            if b < a:
                raise ValueError("a window ends before it starts")
            if (b - a).days + 1 > MAX_DAYS:
                raise ValueError(f"a window spans more than {MAX_DAYS} days")

    @classmethod
    def latest(cls, as_of: date, days: int = 30) -> Windows:
        """The ``days`` days up to ``as_of`` and as many before them."""
        start = as_of - timedelta(days=days - 1)
        return cls(start, as_of, start - timedelta(days=days), start - timedelta(days=1))

    @property
    def periods(self) -> dict[str, tuple[date, date]]:
        return {"current": (self.start, self.end), "previous": (self.comparison_start, self.comparison_end)}

    def days(self, period: str) -> int:
        a, b = self.periods[period]
        return (b - a).days + 1

    def within(self, column: Column | str, period: str) -> Column:
        a, b = self.periods[period]
        return (F.col(column) if isinstance(column, str) else column).between(F.lit(a), F.lit(b))

    def either(self, column: str) -> Column:
        """Literal bounds on the column itself, which reach the Parquet scan."""
        return self.within(column, "current") | self.within(column, "previous")

    def tagged(self, df: DataFrame, column: str) -> DataFrame:
        """One row for each window that a row lies in: a row in both (windows may overlap) appears twice."""
        tags = F.array_compact(F.array(*[F.when(self.within(column, p), F.lit(p)) for p in self.periods]))
        return df.where(self.either(column)).withColumn("period", F.explode(tags))

    def columns(self) -> list[Column]:
        values = {"as_of_date": self.end, "current_start": self.start, "current_end": self.end, "previous_start": self.comparison_start, "previous_end": self.comparison_end}
        return [F.lit(v).cast("date").alias(k) for k, v in values.items()]


def as_of(traffic: DataFrame) -> date:
    """The last traffic date. One row is fetched, so that later bounds are literals that prune files."""
    found = traffic.agg(F.max("date")).first()[0]
    if found is None:
        raise ValueError("no traffic rows")
    return found


def common_as_of(tables) -> date:
    """The last date, which orders, traffic and marketing must share."""
    last = {tables.traffic.agg(F.max("date")).first()[0], tables.orders.agg(F.max("order_date")).first()[0], tables.marketing.agg(F.max("date")).first()[0]}
    if len(last) != 1 or None in last:
        raise ValueError("the tables end on different dates")
    return last.pop()
