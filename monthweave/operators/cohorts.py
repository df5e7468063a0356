"""Card spend of cohorts by the months since they began.

A cohort is all organizations with the same first active month: the first in which they have a
known balance or known spend. That month is month 0 of the cohort, so month 3 is the third month
after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthweave.functions.columns import month_number, month_start, or_zero, ratio
from monthweave.operators.spend import Spend
from monthweave.schemas import BALANCE, MONTH, ORG_ID, SPEND

COHORT = "cohort"


def cohort_months(balances: DataFrame, spend: Spend) -> DataFrame:
    """Columns organization, cohort, offset, spend: one row for each active month of an organization.

    Rows without a date or an organization are in no cohort. Facts are summed to one row a month
    before they meet the other months of their organization, whose rows are as few as the calendar.
    """
    held = balances.where(F.col(BALANCE).isNotNull()).select(ORG_ID, MONTH)
    spent = spend.by_org().where(F.col(SPEND).isNotNull())
    facts = held.unionByName(spent, allowMissingColumns=True).where(
        F.col(ORG_ID).isNotNull() & F.col(MONTH).isNotNull()
    )
    active = facts.groupBy(ORG_ID, month_start(MONTH).alias(MONTH)).agg(F.sum(SPEND).alias("spend"))
    first = F.min(MONTH).over(W.partitionBy(ORG_ID))
    return active.withColumn(COHORT, first).select(
        ORG_ID,
        COHORT,
        (month_number(MONTH) - month_number(COHORT)).alias("offset"),
        or_zero("spend").alias("spend"),
    )


def cohort_usage(months: DataFrame, offsets: Sequence[int], last: date) -> DataFrame:
    """One row for each cohort: its organizations, and for each offset k ``users_k`` (organizations that
    spent) and ``spend_k``.

    ``months`` is the result of ``cohort_months``. Where month k lies after ``last``, its columns are null.
    """
    wanted = months.where(F.col("offset").isin([0, *offsets]))
    sums = [F.count_if(F.col("offset") == 0).alias("organizations")]
    for k in offsets:
        at = F.col("offset") == k
        sums += [
            F.count_if(at & (F.col("spend") != 0)).alias(f"users_{k}"),
            or_zero(F.sum(F.when(at, F.col("spend")))).alias(f"spend_{k}"),
        ]
    found = wanted.groupBy(COHORT).agg(*sums)
    after = month_number(F.lit(last))
    known = lambda k, name: F.when(month_number(COHORT) + k <= after, F.col(name)).alias(name)
    return found.select(
        COHORT, "organizations", *[known(k, f"{what}_{k}") for k in offsets for what in ("users", "spend")]
    )


def spend_per_org(usage: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Add ``per_org_k``: spend in month k over all organizations of the cohort, spending or not."""
    return usage.withColumns(
        {f"per_org_{k}": ratio(F.col(f"spend_{k}"), F.col("organizations")) for k in offsets}
    )


def cohort_trend(usage: DataFrame, offset: int) -> DataFrame:
    """How usage at ``offset`` changes from each cohort to the next one, in the order of the cohorts.

    ``usage`` is a result of ``spend_per_org``. ``change`` is the difference of the spend per organization to the cohort before, ``growth`` their ratio.
    There is one row for each cohort, so no more than the calendar has months.
    """
    before = F.lag(f"per_org_{offset}").over(W.orderBy(COHORT))
    now = F.col(f"per_org_{offset}")
    return usage.select(
        COHORT,
        "organizations",
        F.col(f"users_{offset}").alias("users"),
        F.col(f"spend_{offset}").alias("spend"),
        now.alias("spend_per_org"),
        (now - before).alias("change"),
        ratio(now, before).alias("growth"),
    )
