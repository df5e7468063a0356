from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from monthweave.functions.money import check_overflow, minor_units, with_minor_units


def units(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in df.select(minor_units(F.col("v"))).collect()]


def test_halves_go_away_from_zero(spark):
    assert units(spark, 0.125, -0.125, 1.005, -2.5, 0.0, None, 19.99, -19.99) == [
        13, -13, 100, -250, 0, None, 1999, -1999,
    ]


@pytest.mark.parametrize("value", [float("nan"), float("inf"), -float("inf"), 1e20, -1e15])
def test_what_is_no_amount_fails(spark, value):
    with pytest.raises(Exception, match="no exact amount"):
        units(spark, 1.0, value)


def test_a_remainder_fails(spark):
    df = spark.createDataFrame([(Decimal("1.2300"),), (Decimal("-4.5000"),), (None,)], "v decimal(9,4)")
    assert [r[0] for r in with_minor_units(df, ["v"]).collect()] == [123, -450, None]
    with pytest.raises(Exception, match="remainder"):
        with_minor_units(spark.createDataFrame([(Decimal("1.2390"),)], "v decimal(9,4)"), ["v"]).collect()


def test_sessions_that_may_wrap_are_refused(spark):
    check_overflow(spark)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(RuntimeError):
            check_overflow(spark)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
