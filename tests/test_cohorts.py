"""Cohorts by hand, and frames over months that are missing."""

from __future__ import annotations

import random
from datetime import date

import pytest

from monthweave.operators import cohorts
from monthweave.operators.growth import forward_sums
from monthweave.operators.spend import Spend
from tests.conftest import month

# o1 begins in August 2019 by a balance; o2, o3 in September; o4 in October by spend alone.
BEGUN = {month("2019-08"): 1, month("2019-09"): 2, month("2019-10"): 1}


def test_usage_by_hand(tables):
    _, balances, spend = tables
    months = cohorts.cohort_months(balances, Spend(spend))
    usage = cohorts.cohort_usage(months, (0, 1, 3, 17), date(2021, 1, 1))
    found = {r.cohort: r.asDict() for r in usage.collect()}
    assert {c: r["organizations"] for c, r in found.items()} == BEGUN
    august, september, october = (found[c] for c in sorted(found))
    # o1: nothing in its month 0, 10 in September (1), 40 in November (3), 8 in January 2021 (17).
    assert [float(august[f"spend_{k}"]) for k in (0, 1, 3, 17)] == [0, 10, 40, 8]
    assert [august[f"users_{k}"] for k in (0, 1, 3, 17)] == [0, 1, 1, 1]
    # o2 spends 6 and o3 30 in their month 0, o3 60 in December (3); month 17 of October lies beyond the end.
    assert [float(september[f"spend_{k}"]) for k in (0, 1, 3)] == [36, 0, 60]
    assert [september[f"users_{k}"] for k in (0, 1, 3)] == [2, 0, 1]
    assert float(september["spend_17"] if september["spend_17"] is not None else -1) == -1
    assert (float(october["spend_0"]), october["users_0"], october["users_17"]) == (7, 1, None)


def test_trend_by_hand(books):
    rows = sorted(map(tuple, books.cohort_trend(3).collect()))
    assert [r[:3] for r in rows] == [(month("2019-08"), 1, 1), (month("2019-09"), 2, 1), (month("2019-10"), 1, 0)]
    assert [float(r[3]) for r in rows] == [40, 60, 0]
    assert [r[4] for r in rows] == [40.0, 30.0, 0.0]
    assert [r[5] for r in rows] == [None, -10.0, -30.0]
    assert [r[6] for r in rows] == [None, 0.75, 0.0]


def test_cohorts_of_rows_without_date_owner_or_amount(spark):
    balances = spark.createDataFrame(
        [(None, "a", 1.0), (month("2020-01"), None, 1.0), (month("2020-02"), "a", None), (month("2020-03"), "a", 5.0)],
        "the_month date, organization_id string, available_balance double",
    )
    spend = spark.createDataFrame(
        [("a", date(2020, 3, 17), 2.0), ("a", month("2020-03"), 3.0), ("b", month("2020-01"), None), (None, None, 4.0)],
        "organization_id string, the_month date, debit_card_spend_that_month double",
    )
    months = cohorts.cohort_months(balances, Spend(spend))
    # The days of a month are one month of an organization.
    assert [tuple(r) for r in months.collect()] == [("a", month("2020-03"), 0, 5.0)]
    empty = cohorts.cohort_usage(cohorts.cohort_months(balances.limit(0), Spend(spend.limit(0))), (1,), month("2020-03"))
    assert empty.count() == 0


@pytest.mark.parametrize("share", [0.3, 0.8, 1.0])
def test_frames_over_missing_months(spark, share):
    """By number of the month, a month that is not there adds nothing; counting rows reaches too far."""
    rng = random.Random(3)
    numbers = range(2019 * 12 + 3, 2021 * 12 + 1)
    rows = [
        (s, date(n // 12, n % 12 + 1, 1), rng.randrange(100), rng.randrange(9))
        for s in ("CA", "UT", None)
        for n in numbers
        if rng.random() < share
    ]
    summary = spark.createDataFrame(rows, "state string, the_month date, spend long, customers long")
    found = forward_sums(summary, "state", (2, 4), gaps=True).collect()
    number = lambda d: d.year * 12 + d.month
    for r in found:
        for h in (2, 4):
            ahead = [x for x in rows if x[0] == r.state and 0 < number(x[1]) - number(r.the_month) <= h]
            want = (sum(x[2] for x in ahead), sum(x[3] for x in ahead)) if ahead else (None, None)
            assert (r[f"fwd{h}_spend"], r[f"fwd{h}_customers"]) == want
    by_rows = forward_sums(summary, "state", (2, 4)).collect()
    assert (sorted(map(repr, by_rows)) == sorted(map(repr, found))) == (share == 1.0)
