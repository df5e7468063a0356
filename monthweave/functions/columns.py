"""Column expressions built from Spark's own functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(col: Column | str) -> Column:
    """First day of the month as a DATE, so no session time zone takes part."""
    return F.trunc(col, "month")


def month_number(col: Column | str) -> Column:
    """Months since the year 0, whatever the day; months that follow each other differ by one."""
    return F.year(col) * 12 + F.month(col) - 1


def months_later(month: date, n: int) -> date:
    """First day of the month ``n`` months after ``month``."""
    number = month.year * 12 + month.month - 1 + n
    return date(number // 12, number % 12 + 1, 1)


def or_zero(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0))


def joined_text(names: tuple[str, ...], sep: str) -> Column:
    """Text of several columns with ``sep`` between; a null counts as empty text.

    ``concat_ws`` would drop the separator next to a null, and plain ``concat``
    would turn the whole text null.
    """
    parts: list[Column] = []
    for i, name in enumerate(names):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` in double precision, null where the bottom is zero.

    Both sides become doubles before dividing: a decimal quotient keeps six
    places only, and values that differ further on would tie when ranked.
    """
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
