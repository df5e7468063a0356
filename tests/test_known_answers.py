"""Answers worked out by hand on the small tables of conftest."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from monthweave.functions.money import with_minor_units
from monthweave.operators import growth
from monthweave.operators.calendar import calendar_spine, month_bounds
from monthweave.operators.panel import summarise_panel
from monthweave.operators.spend import Spend
from monthweave.plans.books import Books
from monthweave.plans.settings import (
    ACCOUNT_STUDY,
    STATE,
    STATE_INDUSTRY,
    STATE_INDUSTRY_WEIGHTS,
    STATE_WEIGHTS,
)
from monthweave.schemas import BALANCE, SPEND
from tests.conftest import month


def rows(df, *columns):
    """Rows as plain tuples: numbers as floats, months as text."""

    def plain(v):
        if v is None or isinstance(v, str):
            return v
        return v.strftime("%Y-%m") if hasattr(v, "strftime") else float(v)

    return [tuple(plain(v) for v in r) for r in (df.select(*columns) if columns else df).collect()]


def test_month_bounds(tables):
    _, balances, spend = tables
    assert rows(month_bounds(balances)) == [("2019-08", "2019-09")]
    assert rows(month_bounds(spend)) == [("2019-09", "2021-01")]


def test_calendar(spark, books):
    fixed = [r[0] for r in calendar_spine(spark, ACCOUNT_STUDY.months).collect()]
    assert len(fixed) == 22 == ACCOUNT_STUDY.months.count()
    assert fixed == sorted(set(fixed)) and all(d.day == 1 for d in fixed)
    assert (fixed[0], fixed[-1]) == (month("2019-04"), month("2021-01"))
    found = [r[0] for r in books.calendar_spine().collect()]
    assert found == fixed[4:]


def test_monthly_totals(books):
    assert rows(books.monthly_balance_total()) == [("2019-08", 100.0), ("2019-09", 660.0)]
    assert rows(books.monthly_spend_total()) == [
        ("2019-09", 46.0),
        ("2019-10", 27.0),
        ("2019-11", 40.0),
        ("2019-12", 60.0),
        ("2020-09", 9.0),
        ("2020-10", 9.0),
        ("2021-01", 8.0),
    ]


def test_industry_totals_repeat_spend_per_account(books):
    found = rows(books.industry_totals(), "industry", "total_balance", "total_spend")
    assert sorted(found) == [("b2b", 360.0, 32.0), ("crypto", 0.0, 0.0), ("media", 300.0, 30.0)]


def test_industry_leaders(books):
    assert rows(books.industry_leaders()) == [("b2b", 1.0, 1.0)]


def test_active_region(books):
    active = books.active_users()
    assert active.count() == active.distinct().count() == 12
    counts = rows(books.active_region_counts().orderBy("the_month"))
    assert counts == [
        ("2019-08", 1, 1),
        ("2019-09", 3, 2),
        ("2019-10", 2, 2),
        ("2019-11", 1, 1),
        ("2019-12", 1, 0),
        ("2020-09", 2, 1),
        ("2020-10", 1, 1),
        ("2021-01", 1, 1),
    ]
    shares = rows(books.active_region_share())
    assert shares == [(m, pytest.approx(ca / n)) for m, n, ca in counts]


def test_panel(books):
    panel = books.org_month_panel()
    keys = panel.select("organization_id", "the_month").distinct().count()
    assert keys == 5 * 22
    assert panel.count() == 5 * 22 + 1  # o1 twice in 2019-09
    september = panel.where(F.col("the_month") == month("2019-09"))
    assert sorted(rows(september, "organization_id", BALANCE, SPEND)) == [
        ("o1", 100.0, 10.0),
        ("o1", 250.0, 10.0),
        ("o2", 5.0, 6.0),
        ("o3", 300.0, 30.0),
        ("o4", 0.0, 0.0),
        ("o5", 0.0, 0.0),
    ]


def test_state_summary(books):
    summary = books.month_summary(STATE)
    assert summary.count() == 4 * 22
    september = summary.where(F.col("the_month") == month("2019-09"))
    found = rows(september, "region_or_state", "balance", "spend", "customers")
    assert sorted(found) == [
        ("CA", 355.0, 26.0, 2.0),
        ("UT", 300.0, 30.0, 1.0),
        ("WY", 0.0, 0.0, 1.0),
        ("ca", 0.0, 0.0, 1.0),
    ]
    per_month = summary.groupBy("the_month").agg(F.sum("customers").alias("n"))
    assert {r.n for r in per_month.collect()} == {5}


@pytest.mark.parametrize("segment", [STATE, STATE_INDUSTRY])
def test_summary_without_panel_equals_panel_roll_up(books, segment):
    columns = (segment.name, "the_month", "balance", "spend", "customers")
    direct = rows(books.month_summary(segment), *columns)
    rolled = rows(summarise_panel(books.org_month_panel(), segment), *columns)
    assert sorted(direct) == sorted(rolled)


def test_forward_spend(books):
    ca = books.forward_spend(STATE).where(F.col("region_or_state") == "CA")
    found = rows(
        ca, "the_month", "spend", "customers",
        "fwd2_spend", "fwd2_customers", "fwd4_spend", "fwd4_customers",
    )
    found = {r[0]: r[1:] for r in found}
    assert found["2019-08"] == (0, 2, 46, 4, 86, 8)
    assert found["2019-09"] == (26, 2, 60, 4, 60, 8)
    assert found["2019-10"] == (20, 2, 40, 4, 40, 8)
    assert found["2020-09"] == (4, 2, 9, 4, 17, 8)
    assert found["2020-10"] == (9, 2, 0, 4, 8, 6)
    assert found["2020-11"] == (0, 2, 8, 4, 8, 4)
    assert found["2020-12"] == (0, 2, 8, 2, 8, 2)
    assert found["2021-01"] == (8, 2, None, None, None, None)


def test_anchor_averages_and_snapshot(books):
    found = rows(books.anchor_averages(STATE).where(F.col("region_or_state") == "CA"))
    assert sorted(found) == [
        ("CA", "2019-09", 26.0, 13.0, 15.0, 7.5),
        ("CA", "2020-09", 4.0, 2.0, 2.25, 2.125),
    ]
    latest = rows(books.latest_spend(STATE))
    assert sorted(latest) == [("CA", 8.0), ("UT", 0.0), ("WY", 0.0), ("ca", 0.0)]


EXPECTED_RANKS = [
    ("CA", "2019-09", 8.0, 15 / 13, 7.5 / 13, 4, 4, 4),
    ("CA", "2020-09", 8.0, 1.125, 1.0625, 4, 4, 4),
    ("UT", "2019-09", 0.0, 0.0, 0.5, 1, 3, 3),
    ("UT", "2020-09", 0.0, 0.0, 0.0, 1, 3, 3),
    ("WY", "2019-09", 0.0, None, None, 1, 1, 1),
    ("WY", "2020-09", 0.0, None, None, 1, 1, 1),
    ("ca", "2019-09", 0.0, None, None, 1, 1, 1),
    ("ca", "2020-09", 0.0, None, None, 1, 1, 1),
]


def test_growth_ranks(books):
    spec = ACCOUNT_STUDY.growth(STATE_WEIGHTS)
    ranks = growth.growth_ranks(books.growth_ratios(STATE, spec), STATE.name, spec)
    assert sorted(rows(ranks)) == EXPECTED_RANKS


def test_latest_spend_is_null_outside_the_calendar(books):
    spec = growth.GrowthSpec(month("2022-01"), ACCOUNT_STUDY.growth(STATE_WEIGHTS).weights)
    assert {r.latest_spend for r in books.growth_ratios(STATE, spec).collect()} == {None}


def test_growth_index_state(books):
    assert rows(books.growth_index_state()) == [("CA", 8.0, 12.8), ("UT", 0.0, 8.0)]
    everyone = books.growth_index(STATE, ACCOUNT_STUDY.growth(STATE_WEIGHTS))
    assert rows(everyone) == [("CA", 8, 12.8), ("UT", 0, 8.0), ("WY", 0, 3.2), ("ca", 0, 3.2)]


def test_growth_index_state_industry(books):
    assert rows(books.growth_index_state_industry()) == [
        ("CA-b2b", 8.0, 14.4),
        ("UT-media", 0.0, 8.4),
        ("WY-crypto", 0.0, 3.6),
        ("ca-media", 0.0, 3.6),
    ]


def test_index_is_zero_at_other_months(books):
    spec = ACCOUNT_STUDY.growth(STATE_WEIGHTS)
    ranks = growth.growth_ranks(books.growth_ratios(STATE, spec), STATE.name, spec)
    moved = ranks.withColumn("the_month", F.add_months("the_month", 1))
    found = growth.index_components(moved, STATE.name, spec)
    assert {float(r.growth_index) for r in found.collect()} == {0.0}


def test_cents_give_the_same_answers(tables, books):
    orgs, balances, spend = tables
    cents = Books(
        orgs,
        with_minor_units(balances, [BALANCE]),
        Spend(with_minor_units(spend, [SPEND])),
        ACCOUNT_STUDY,
        cents=True,
    )
    assert rows(cents.monthly_balance_total()) == rows(books.monthly_balance_total())
    assert sorted(rows(cents.org_month_panel())) == sorted(rows(books.org_month_panel()))
    assert rows(cents.growth_index(STATE_INDUSTRY, ACCOUNT_STUDY.growth(STATE_INDUSTRY_WEIGHTS))) == rows(
        books.growth_index_state_industry()
    )
