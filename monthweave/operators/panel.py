"""Zero-filled organization-by-month panel and its roll-up to segments.

Both read one row per organization and balances unique per (account, month);
``contracts`` checks that.

Panel rows are distinct without the account: accounts of one organization with
equal balances fall into one row, and spend repeats once per distinct balance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthweave.functions.columns import joined_text, or_zero
from monthweave.operators.calendar import Months
from monthweave.operators.spend import Spend
from monthweave.schemas import BALANCE, MONTH, ORG_ID, SPEND


@dataclass(frozen=True)
class Segment:
    """One or more organization columns seen as a single text key ``name``."""

    name: str
    columns: tuple[str, ...]
    sep: str = "-"

    def column(self) -> Column:
        if len(self.columns) == 1:
            return F.col(self.columns[0]).alias(self.name)
        return joined_text(self.columns, self.sep).alias(self.name)


def total_balances(balances: DataFrame) -> DataFrame:
    """One balance for each organization and month, the sum over its accounts.

    Given to the panel or the summary in place of the balances, it makes both count each
    organization's spend once, and equal balances of two accounts as two.
    """
    return balances.groupBy(ORG_ID, MONTH).agg(F.sum(or_zero(BALANCE)).alias(BALANCE))


def distinct_balances(balances: DataFrame, months: Months) -> DataFrame:
    """Distinct (organization, month, balance) within the range, null balance as zero."""
    return (
        balances.where(months.covers(F.col(MONTH)))
        .select(ORG_ID, MONTH, or_zero(BALANCE).alias(BALANCE))
        .distinct()
    )


def org_month_panel(
    dim: DataFrame,
    balances: DataFrame,
    spend: Spend,
    months: Months,
    attributes: Sequence[str] | None = None,
) -> DataFrame:
    """Every organization in every month, with balance and spend or zero.

    Rows with a balance come from the balances. The other months are filled in
    per organization from two arrays that cannot outgrow the calendar (months
    with a balance, spend by month), so the organizations x months rows come
    into being after the last shuffle and no join or distinct moves them. An
    empty range keeps each organization once, with a null month.
    """
    kept = [c for c in (attributes or dim.columns) if c != ORG_ID]
    held = distinct_balances(balances, months)
    spent = spend.table().where(months.covers(F.col(MONTH)))
    orgs = _with_month_map(dim.select(ORG_ID, *kept), spent, SPEND, "_spent")
    spend_of_month = or_zero(F.col("_spent")[F.col(MONTH)]).alias(SPEND)

    with_balance = held.join(orgs, ORG_ID).select(ORG_ID, *kept, MONTH, BALANCE, spend_of_month)

    # A list, not a set: Spark would take the distinct out from under a set, and then
    # read and shuffle the balances a second time.
    held_months = held.groupBy(ORG_ID).agg(F.collect_list(MONTH).alias("_held"))
    gaps = orgs.join(held_months, ORG_ID, "left")
    if months.count():
        none_held = F.array().cast("array<date>")
        open_months = F.array_except(months.dates(), F.coalesce("_held", none_held))
        gaps = gaps.withColumn(MONTH, F.explode(open_months))
    else:
        gaps = gaps.withColumn(MONTH, F.lit(None).cast("date"))
    without_balance = gaps.select(
        ORG_ID,
        *kept,
        MONTH,
        F.lit(0).cast(held.schema[BALANCE].dataType).alias(BALANCE),
        spend_of_month,
    )
    return with_balance.unionByName(without_balance)


def summarise_panel(panel: DataFrame, segment: Segment) -> DataFrame:
    """Balance, spend and distinct organizations per segment and month of a panel."""
    return panel.groupBy(segment.column(), MONTH).agg(
        F.sum(BALANCE).alias("balance"),
        F.sum(SPEND).alias("spend"),
        F.count_distinct(ORG_ID).alias("customers"),
    )


def segment_month_summary(
    dim: DataFrame,
    balances: DataFrame,
    spend: Spend,
    months: Months,
    segment: Segment,
    with_balance: bool = True,
) -> DataFrame:
    """What ``summarise_panel`` gives, without building the panel.

    Sums are linear, so spend rows go straight to (segment, month), each times
    the number of distinct balances its organization holds that month. The zero
    months come from one row per segment times the calendar, added as zero
    amounts into the same sum. Growth needs no balances; ``with_balance=False``
    leaves them out.
    """
    members = dim.select(ORG_ID, segment.column())
    held = (
        distinct_balances(balances, months)
        .groupBy(ORG_ID, MONTH)
        .agg(F.sum(BALANCE).alias("balance"), F.count(F.lit(1)).alias("_times"))
    )
    repeated = held.where(F.col("_times") > 1)
    times = F.coalesce(F.col("_repeats")[F.col(MONTH)], F.lit(1))
    spent = (
        spend.joined_to(_with_month_map(members, repeated, "_times", "_repeats"))
        .where(months.covers(F.col(MONTH)))
        .select(segment.name, MONTH, (or_zero(SPEND) * times).alias("spend"))
    )
    frame = (
        members.groupBy(segment.name)
        .agg(F.count(F.lit(1)).alias("customers"))
        .select(segment.name, F.explode_outer(months.dates()).alias(MONTH), "customers")
    )
    parts = [spent, frame]
    if with_balance:
        parts.append(held.join(members, ORG_ID).select(segment.name, MONTH, "balance"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    measures = (["balance"] if with_balance else []) + ["spend", "customers"]
    return rows.groupBy(segment.name, MONTH).agg(
        *[or_zero(F.sum(m)).alias(m) for m in measures]
    )


def _with_month_map(
    members: DataFrame, by_month: DataFrame, value: str, output: str
) -> DataFrame:
    """Add ``output``, a map from month to ``value``, to each organization.

    ``by_month`` holds each (organization, month) once, so a map has no more
    entries than the calendar has months. The join takes a bucket of the id as
    second key: its result is then not partitioned by the id alone, and a join on
    the id that follows shuffles both of its sides. Only such joins let AQE split
    an organization that holds a large part of the other side.
    """
    # Never null, so no null filter sets one use of the balances apart from another.
    bucket = F.hash(ORG_ID).bitwiseAND(1023).alias("_bucket")
    maps = (
        by_month.select(ORG_ID, bucket, F.struct(MONTH, value).alias("_entry"))
        .groupBy(ORG_ID, "_bucket")
        .agg(F.map_from_entries(F.collect_list("_entry")).alias(output))
    )
    return members.select("*", bucket).join(maps, [ORG_ID, "_bucket"], "left").drop("_bucket")
