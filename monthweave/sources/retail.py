"""The organization, balance and spend tables, made from order data.

A customer is an organization, its orders are account movements (one account per
order priority) and its shipped lines are card spend. Amounts are whole cents
(see ``functions.money``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.functions.columns import month_start, months_later
from monthweave.functions.money import check_overflow, minor_units
from monthweave.operators.calendar import Months
from monthweave.operators.spend import Spend
from monthweave.schemas import ACCOUNT_ID, BALANCE, INDUSTRY, MONTH, ORG_ID, REGION, SPEND


# The columns read and their types.
COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_shipdate timestamp_ntz",
}


@dataclass(frozen=True)
class RetailTables:
    """Tables over a folder of customer, nation, region, orders and lineitem Parquet.

    Every fact takes the months wanted, which become a date filter on the
    scan. ``balance_lines`` are the movements before they are summed to a balance:
    a total or a distinct over them needs no shuffle by account first. With ``dates_kept`` facts
    keep their days in the month column instead of being rounded down to months. ``stored`` has
    tables that are read instead of the folder's, with the columns of ``COLUMNS``.
    """

    spark: SparkSession
    folder: str
    dates_kept: bool = False
    stored: Mapping[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        check_overflow(self.spark)

    def dated(self) -> RetailTables:
        return replace(self, dates_kept=True)

    def read(self, name: str) -> DataFrame:
        if name in self.stored:
            return self.stored[name]
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self.folder}/{name}.parquet")

    def _month(self, column: str, months: Months | None) -> Column:
        """The month of a date; a constant in a one-month scan, so grouping drops it."""
        if self.dates_kept:
            return F.to_date(column).alias(MONTH)
        if months is not None and months.count() == 1:
            return F.lit(months.ranges()[0].first).alias(MONTH)
        return month_start(column).alias(MONTH)

    def organizations(self, with_country: bool = False) -> DataFrame:
        places = self.read("nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias(REGION), "n_regionkey"
        )
        columns = [REGION]
        if with_country:
            countries = self.read("region").select(
                F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("country")
            )
            places = places.join(countries, "n_regionkey", "left")
            columns.append("country")
        return (
            self.read("customer")
            .join(places, "c_nationkey", "left")
            .select(F.col("c_custkey").alias(ORG_ID), F.col("c_mktsegment").alias(INDUSTRY), *columns)
        )

    def balance_lines(self, months: Months | None = None) -> DataFrame:
        orders = _within(self.read("orders"), "o_orderdate", months)
        return orders.select(
            self._month("o_orderdate", months),
            F.col("o_custkey").alias(ORG_ID),
            F.left("o_orderpriority", F.lit(1)).alias("_account"),
            minor_units(F.col("o_totalprice")).alias(BALANCE),
        )

    def balances(self, months: Months | None = None) -> DataFrame:
        return with_account_id(
            self.balance_lines(months)
            .groupBy(MONTH, ORG_ID, "_account")
            .agg(F.sum(BALANCE).alias(BALANCE))
        )

    def orders_and_lines(self) -> tuple[DataFrame, DataFrame]:
        """All movements with their order key, and all lines with that of their order."""
        orders = self.read("orders").select(
            "o_orderkey",
            F.col("o_custkey").alias(ORG_ID),
            self._month("o_orderdate", None),
            minor_units(F.col("o_totalprice")).alias(BALANCE),
        )
        return orders, self.spend().rows

    def spend(self, months: Months | None = None) -> Spend:
        """Spend by order line; a line finds its organization through its order."""
        lines = _within(self.read("lineitem"), "l_shipdate", months).select(
            F.col("l_orderkey").alias("o_orderkey"),
            self._month("l_shipdate", months),
            minor_units(F.col("l_extendedprice")).alias(SPEND),
        )
        owners = self.read("orders").select("o_orderkey", F.col("o_custkey").alias(ORG_ID))
        return Spend(lines, owners, link="o_orderkey")


def with_account_id(df: DataFrame) -> DataFrame:
    """Name the account; grouping by its parts first keeps long text out of the shuffle."""
    account = F.concat(F.col(ORG_ID).cast("string"), F.lit("-"), F.col("_account"))
    return df.select(MONTH, ORG_ID, account.alias(ACCOUNT_ID), BALANCE)


def _within(df: DataFrame, column: str, months: Months | None) -> DataFrame:
    """Filter on the stored date, so the file scan can skip what lies outside."""
    if months is None:
        return df
    day = F.col(column)
    spans = [
        (day >= _midnight(r.first)) & (day < _midnight(months_later(r.last, 1)))
        for r in months.ranges()
    ]
    return df.where(reduce(lambda a, b: a | b, spans, F.lit(False)))


def _midnight(day: date) -> Column:
    return F.lit(datetime(day.year, day.month, day.day).isoformat(" ")).cast("timestamp_ntz")

