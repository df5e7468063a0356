"""Monthly totals, segment totals at one month, and the leading segments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.functions.columns import month_start, or_zero
from monthweave.functions.layout import in_month_order
from monthweave.operators.ranking import Rank, add_ranks
from monthweave.schemas import BALANCE, MONTH, ORG_ID, SPEND


def monthly_total(df: DataFrame, measure: str, output: str, month: str = MONTH) -> DataFrame:
    """Sum of ``measure`` per calendar month, in month order."""
    totals = df.groupBy(month_start(month).alias(MONTH)).agg(F.sum(measure).alias(output))
    return in_month_order(totals)


def segment_totals(
    dim: DataFrame, balances: DataFrame, spend: DataFrame, segment: str, at_month: date | DataFrame
) -> DataFrame:
    """Balance and spend per segment in one month; segments without any get zeros.

    The totals are those of joining both facts to the organizations row by row:
    an organization with k accounts brings its spend k times. Each fact is
    reduced to one row per organization before the join, so the join fans
    nothing out and a large organization is one row on every side. ``spend`` may
    hold several rows per organization, which add up. ``at_month`` is a date, or a relation
    whose latest ``the_month`` is wanted, see ``rows_at``.
    """
    accounts = (
        rows_at(balances, at_month)
        .groupBy(ORG_ID)
        .agg(F.sum(or_zero(BALANCE)).alias("_balance"), F.count(F.lit(1)).alias("_accounts"))
    )
    cards = rows_at(spend, at_month).groupBy(ORG_ID).agg(F.sum(or_zero(SPEND)).alias("_spend"))
    return (
        dim.select(ORG_ID, segment)
        .join(accounts, ORG_ID, "left")
        .join(cards, ORG_ID, "left")
        .groupBy(segment)
        .agg(
            F.sum(or_zero("_balance")).alias("total_balance"),
            F.sum(or_zero("_spend") * F.coalesce("_accounts", F.lit(1))).alias("total_spend"),
        )
    )


def rows_at(facts: DataFrame, at_month: date | DataFrame) -> DataFrame:
    """The facts of one month.

    A relation is read when the question runs. Its latest month is one row, so it is broadcast, and
    facts stored by month are pruned to it as they are read, like those of a date known before.
    """
    if isinstance(at_month, DataFrame):
        wanted = at_month.agg(F.max(MONTH).alias(MONTH))
        return facts.join(F.broadcast(wanted), MONTH, "left_semi")
    return facts.where(F.col(MONTH) == F.lit(at_month))


def leaders(totals: DataFrame, segment: str) -> DataFrame:
    """Segments that rank first on balance or on spend, with both ranks; ties stay."""
    ranked = add_ranks(
        totals,
        [
            Rank("balance_rank", "total_balance", descending=True),
            Rank("spend_rank", "total_spend", descending=True),
        ],
        key=(segment,),
    )
    first = (F.col("balance_rank") == 1) | (F.col("spend_rank") == 1)
    return ranked.where(first).select(segment, "balance_rank", "spend_rank")
