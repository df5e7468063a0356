"""Month ranges: bounds of a fact and the gap-free spine between two months."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.functions.columns import month_start, months_later
from monthweave.schemas import MONTH


@dataclass(frozen=True)
class MonthRange:
    """All first-of-month dates from ``first`` to ``last``, both included."""

    first: date
    last: date

    def __post_init__(self):
        if self.first.day != 1 or self.last.day != 1:
            raise ValueError("a month range runs from a first of the month to another")

    def ranges(self) -> tuple[MonthRange, ...]:
        return (self,) if self.first <= self.last else ()

    def count(self) -> int:
        span = (self.last.year - self.first.year) * 12 + self.last.month - self.first.month
        return max(span + 1, 0)

    def dates(self) -> Column:
        """The months as one array; rows explode it, so no join makes the spine."""
        if not self.ranges():
            return F.array().cast("array<date>")
        return F.sequence(F.lit(self.first), F.lit(self.last), F.expr("interval 1 month"))

    def covers(self, col: Column) -> Column:
        """Whether a date is one of the months; other days of a month are not."""
        return _within(self.ranges(), col)


def _within(ranges: tuple[MonthRange, ...], col: Column) -> Column:
    spans = [col.between(F.lit(r.first), F.lit(r.last)) for r in ranges]
    return reduce(lambda a, b: a | b, spans, F.lit(False)) & (month_start(col) == col)


@dataclass(frozen=True)
class MonthRanges:
    """Several month ranges, in order and apart from each other; ``merged`` makes them so."""

    parts: tuple[MonthRange, ...]

    @classmethod
    def merged(cls, ranges: Iterable[MonthRange]) -> MonthRanges:
        out: list[MonthRange] = []
        for r in sorted((r for r in ranges if r.ranges()), key=lambda r: r.first):
            if out and r.first <= months_later(out[-1].last, 1):
                out[-1] = MonthRange(out[-1].first, max(out[-1].last, r.last))
            else:
                out.append(r)
        return cls(tuple(out))

    def ranges(self) -> tuple[MonthRange, ...]:
        return self.parts

    def count(self) -> int:
        return sum(r.count() for r in self.parts)

    def dates(self) -> Column:
        if not self.parts:
            return F.array().cast("array<date>")
        return F.concat(*[r.dates() for r in self.parts])

    def covers(self, col: Column) -> Column:
        return _within(self.parts, col)


Months = MonthRange | MonthRanges


def month_bounds(df: DataFrame, month: str = MONTH, rounded: bool = False) -> DataFrame:
    """One row: first and last month found.

    ``rounded`` is for a column of days: the two results are rounded down, not every row.
    """
    found = df.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    if not rounded:
        return found
    return found.select(*[month_start(c).alias(c) for c in found.columns])


def calendar_spine(spark: SparkSession, months: Months) -> DataFrame:
    """One row per month of known ranges."""
    return spark.range(0, 1, 1, 1).select(F.explode(months.dates()).alias(MONTH))


def spine_over(facts: list[DataFrame], month: str = MONTH) -> DataFrame:
    """One row per month from the earliest to the latest month in any of ``facts``."""
    bounds = reduce(DataFrame.unionByName, [month_bounds(f, month) for f in facts])
    span = bounds.agg(
        month_start(F.min("first_month")).alias("first_month"),
        month_start(F.max("last_month")).alias("last_month"),
    )
    steps = F.sequence("first_month", "last_month", F.expr("interval 1 month"))
    return span.select(F.explode(steps).alias(MONTH))
