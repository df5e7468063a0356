"""Monthly active organizations and the share of them in one region.

Who was active when is held in bitmaps of months, so that an organization is one row for some
five years and no row for each of its months is shuffled. The counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthweave.functions.columns import month_number, ratio
from monthweave.functions.layout import in_month_order
from monthweave.operators.spend import Spend
from monthweave.schemas import BALANCE, MONTH, ORG_ID, REGION, SPEND

#: Months in one bitmap, a bigint.
MONTHS_HELD = 64


def month_bitmaps(rows: DataFrame, *key: str) -> DataFrame:
    """Columns of ``key``, _span, _day, _months: the distinct dates of each key, 64 months in a row.

    A date that is not the first of its month keeps its day. A null date is in a row of its own.
    """
    number = month_number(F.col(MONTH))
    place = F.pmod(number, F.lit(MONTHS_HELD)).alias("_place")
    placed = rows.select(*key, F.floor(number / MONTHS_HELD).alias("_span"), F.day(MONTH).alias("_day"), place)
    return placed.groupBy(*key, "_span", "_day").agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias("_months"))


def dates_held() -> Column:
    """The dates of a row of ``month_bitmaps``, each once."""
    places = F.filter(F.sequence(F.lit(0), F.lit(MONTHS_HELD - 1)), lambda p: F.getbit("_months", p) == 1)
    number = lambda p: F.col("_span") * MONTHS_HELD + p
    date = lambda p: F.make_date(
        F.floor(number(p) / 12).cast("int"), (number(p) % 12 + 1).cast("int"), F.col("_day")
    )
    none = F.array(F.lit(None).cast("date"))
    return F.when(F.col("_span").isNull(), none).otherwise(F.transform(places, date))


def active_users(balances: DataFrame, spend: Spend) -> DataFrame:
    """Distinct (organization, month) with a known balance or known spend."""
    return _active(balances, spend.by_org()).select(ORG_ID, F.explode(dates_held()).alias(MONTH))


def active_region_counts(
    balances: DataFrame, spend: Spend, dim: DataFrame, region: str, region_column: str = REGION
) -> DataFrame:
    """Per month: active organizations, and those of them in ``region`` (any case).

    Only the organizations of the region take part in the join. The mark goes on
    before the bitmaps are made, where linked spend gets it through its owners; each
    organization then has each month once, and plain counts are distinct counts.
    """
    members = _members(dim, region, region_column)
    active = _active(
        balances.join(members, ORG_ID, "left"), spend.joined_to(members, "left"), "_in_region"
    )
    return _counts(active)


def linked_region_counts(
    owners: DataFrame, rows: DataFrame, link: str, dim: DataFrame, region: str, region_column: str = REGION
) -> DataFrame:
    """The same where each balance movement owns spend rows: ``owners`` has one row a link
    with organization, month and balance, ``rows`` have the link, month and spend.

    Owners get their mark once and are shuffled once for it. Rows shrink to the set of months of
    their link, no longer than the calendar, before they meet their owner, so a
    link that holds most of them is one row. Rows without an owner count no one.
    """
    marked = owners.join(_members(dim, region, region_column), ORG_ID, "left")
    spent = rows.where(F.col(SPEND).isNotNull()).groupBy(link).agg(F.collect_set(MONTH).alias("_spent"))
    none = F.array().cast("array<date>")
    held = F.when(F.col(BALANCE).isNotNull(), F.array(MONTH)).otherwise(none)
    months = F.concat(F.coalesce("_spent", none), held)
    both = marked.join(spent, link, "full_outer")
    dated = both.select(ORG_ID, "_in_region", F.explode(months).alias(MONTH))
    return _counts(month_bitmaps(dated, ORG_ID, "_in_region"))


def _members(dim: DataFrame, region: str, region_column: str) -> DataFrame:
    return dim.where(F.upper(region_column) == F.lit(region.upper())).select(
        ORG_ID, F.lit(True).alias("_in_region")
    )


def _counts(active: DataFrame) -> DataFrame:
    """Of bitmaps; their months are counted where they lie."""
    return (
        active.select(ORG_ID, "_in_region", F.explode(dates_held()).alias(MONTH))
        .groupBy(MONTH)
        .agg(F.count(ORG_ID).alias("active_users"), F.count("_in_region").alias("region_users"))
    )


def _active(balances: DataFrame, spend: DataFrame, *marks: str) -> DataFrame:
    held = balances.where(F.col(BALANCE).isNotNull()).select(ORG_ID, MONTH, *marks)
    spent = spend.where(F.col(SPEND).isNotNull()).select(ORG_ID, MONTH, *marks)
    return month_bitmaps(held.unionByName(spent), ORG_ID, *marks)


def active_region_share(counts: DataFrame) -> DataFrame:
    """Share (0 to 1) of the active organizations that are in the region, by month."""
    share = ratio(F.col("region_users"), F.col("active_users")).alias("region_share")
    return in_month_order(counts.select(MONTH, share))
