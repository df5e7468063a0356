"""Exact money.

Sums over large tables run on whole minor units (cents) held in a bigint: the
sum is exact, stays in generated code and shuffles 8 bytes per value, where a
decimal sum allocates an object per row. Decimals come back once the rows have
been reduced. A bigint sum holds 9.2e16 units of two decimal places; ``check_overflow``
makes sure that the session fails on overflow and never wraps. Amounts that are no
amounts fail the job too: NaN, infinity, what a double holds less exactly than a minor
unit, and decimals with a remainder below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Doubles beyond this many minor units have no place for halves.
LARGEST = float(2**52)


def check_overflow(spark: SparkSession) -> None:
    """Refuse a session in which a sum of minor units may wrap."""
    if spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
        raise RuntimeError("exact sums need spark.sql.ansi.enabled")


def minor_units(col: Column, scale: int = 2) -> Column:
    """Whole minor units of a double, halves away from zero.

    NaN is larger than any limit to Spark, so one comparison refuses all that is no amount.
    """
    units = F.abs(col) * F.lit(float(10**scale))
    whole = F.floor(units + F.lit(0.5))
    bad = F.raise_error(F.concat(F.lit("no exact amount: "), col.cast("string"))).cast("bigint")
    return F.when(units > F.lit(LARGEST), bad).when(col < 0, -whole).otherwise(whole)


def decimal_from_minor(col: Column, scale: int = 2) -> Column:
    """Exact decimal of a count of minor units."""
    return col.cast(T.DecimalType(20, 0)) * F.lit(Decimal(1).scaleb(-scale))


def with_minor_units(df: DataFrame, columns: Sequence[str], scale: int = 2) -> DataFrame:
    """Turn decimal columns into whole minor units, to make the sums over them cheap.

    A remainder below a minor unit fails the job.
    """

    def units(name: str) -> Column:
        whole = (F.col(name) * F.lit(10**scale)).cast("bigint")
        bad = F.raise_error(F.concat(F.lit(f"{name} has a remainder: "), F.col(name).cast("string")))
        return F.when(whole != F.col(name) * F.lit(10**scale), bad.cast("bigint")).otherwise(whole)

    return df.withColumns({c: units(c) for c in columns})


def with_decimals(df: DataFrame, columns: Sequence[str], scale: int = 2) -> DataFrame:
    """Turn minor units back into decimals."""
    return df.withColumns({c: decimal_from_minor(F.col(c), scale) for c in columns})


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles for the result a reader sees; do this last, after all sums."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
