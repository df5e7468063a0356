"""Random small tables: Spark against plain Python over every organization and month."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from monthweave.operators import growth
from monthweave.operators.activity import dates_held, month_bitmaps
from monthweave.operators.calendar import MonthRange, MonthRanges
from monthweave.operators.growth import AnchorWeights, GrowthSpec, growth_ratios
from monthweave.operators.panel import Segment, org_month_panel, segment_month_summary
from monthweave.operators.ranking import Rank, add_ranks, value_range
from monthweave.operators.spend import Spend
from monthweave.operators.totals import segment_totals
from monthweave.plans import retail
from monthweave.plans.books import Books
from monthweave.plans.settings import (
    ACCOUNT_STUDY,
    STATE,
    STATE_INDUSTRY,
    STATE_INDUSTRY_WEIGHTS,
    STATE_WEIGHTS,
)
from monthweave.schemas import BALANCES, ORGANIZATIONS, SPENDING
from monthweave.sources.tables import rows_of
from tests.conftest import org_row

MONTHS = [date(2020 + k // 12, k % 12 + 1, 1) for k in range(14)]
STUDIED = MonthRange(MONTHS[2], MONTHS[11])


def random_tables(seed: int, hot: bool):
    """Few amounts, so that equal balances and ties are common. ``hot`` gives the
    first organization a third or more of all accounts and spend."""
    rng = random.Random(seed)
    orgs = [
        (f"o{i}", rng.choice(["b2b", "media", "crypto"]), rng.choice(["CA", "ca", "UT"]))
        for i in range(9)
    ]
    balances, spend = [], []
    for i, (org, _, _) in enumerate(orgs[:-1] + [("stranger", "", "")]):
        for m in MONTHS:
            accounts = 12 if hot and i == 0 else rng.choice([0, 0, 1, 2, 3])
            for a in range(accounts):
                balances.append((m, org, f"{org}-{a}", Decimal(rng.choice([0, 5, 5, 7, 900]))))
            if (hot and i == 0) or rng.random() < 0.5:
                spend.append((org, m, Decimal(rng.randint(0, 500)) / 100))
    return orgs, balances, spend


def brute_panel(orgs, balances, spend, months):
    held = defaultdict(set)
    for m, org, _, amount in balances:
        held[org, m].add(amount)
    spent = {(org, m): amount for org, m, amount in spend}
    return {
        (org, industry, region, m, balance, spent.get((org, m), Decimal(0)))
        for org, industry, region in orgs
        for m in months
        for balance in held.get((org, m), {Decimal(0)})
    }


def as_frames(spark, orgs, balances, spend):
    return (
        rows_of(spark, ORGANIZATIONS, [org_row(*o) for o in orgs]),
        rows_of(spark, BALANCES, balances),
        rows_of(spark, SPENDING, spend),
    )


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, False)])
def test_panel_and_summary(spark, seed, hot):
    orgs, balances, spend = random_tables(seed, hot)
    frames = as_frames(spark, orgs, balances, spend)
    expected = brute_panel(orgs, balances, spend, MONTHS[2:12])

    panel = org_month_panel(
        frames[0], frames[1], Spend(frames[2]), STUDIED, ["industry", "region_or_state"]
    )
    found = [tuple(r) for r in panel.collect()]
    assert len(found) == len(set(found)) == len(expected)
    assert set(found) == expected

    segment = Segment("state_industry", ("region_or_state", "industry"))
    sums = defaultdict(lambda: [Decimal(0), Decimal(0), set()])
    for org, industry, region, m, balance, amount in expected:
        entry = sums[f"{region}-{industry}", m]
        entry[0] += balance
        entry[1] += amount
        entry[2].add(org)
    want = {(k, m, b, s, len(o)) for (k, m), (b, s, o) in sums.items()}
    summary = segment_month_summary(frames[0], frames[1], Spend(frames[2]), STUDIED, segment)
    got = {
        (r.state_industry, r.the_month, r.balance, r.spend, r.customers) for r in summary.collect()
    }
    assert got == want

    without = segment_month_summary(
        frames[0], frames[1], Spend(frames[2]), STUDIED, segment, with_balance=False
    )
    assert {(r.state_industry, r.the_month, r.spend, r.customers) for r in without.collect()} == {
        (k, m, s, n) for k, m, _, s, n in want
    }


@pytest.mark.parametrize("seed,hot", [(4, False), (5, True)])
def test_segment_totals(spark, seed, hot):
    orgs, balances, spend = random_tables(seed, hot)
    frames = as_frames(spark, orgs, balances, spend)
    at = MONTHS[5]
    want = defaultdict(lambda: [Decimal(0), Decimal(0)])
    for org, industry, _ in orgs:
        mine = [b for m, o, _, b in balances if (m, o) == (at, org)] or [Decimal(0)]
        amount = sum((a for o, m, a in spend if (m, o) == (at, org)), Decimal(0))
        for b in mine:
            want[industry][0] += b
            want[industry][1] += amount
    found = segment_totals(*frames, "industry", at).collect()
    assert {r.industry: [r.total_balance, r.total_spend] for r in found} == want


def test_linked_spend_equals_direct_spend(spark):
    orgs, balances, spend = random_tables(6, True)
    dim, held, _ = as_frames(spark, orgs, balances, spend)
    lines, owners = [], []
    for i, (org, m, amount) in enumerate(spend):
        owners.append((i, org))
        lines += [(i, m, amount / 2), (i, m, amount / 2)]
    lines.append((10_000, MONTHS[4], Decimal(77)))  # a line without an owner
    rows = spark.createDataFrame(lines, "k long, the_month date, debit_card_spend_that_month decimal(12,4)")
    linked = Spend(rows, spark.createDataFrame(owners, "k long, organization_id string"), "k")
    direct = Spend(
        spark.createDataFrame(
            spend, "organization_id string, the_month date, debit_card_spend_that_month decimal(12,4)"
        )
    )
    segment = Segment("region_or_state", ("region_or_state",))

    def summary(s):
        found = segment_month_summary(dim, held, s, STUDIED, segment)
        return {tuple(r) for r in found.select(sorted(found.columns)).collect()}

    assert summary(linked) == summary(direct)
    assert summary(replace(linked, owners_first=False)) == summary(direct)
    assert {tuple(r) for r in linked.table().dropna().collect()} == {
        tuple(r) for r in direct.table().collect()
    }
    unknown = linked.table().where("organization_id IS NULL").collect()
    assert [(r[1], float(r[2])) for r in unknown] == [(MONTHS[4], 77.0)]


def test_empty_calendar_keeps_each_organization_once(spark):
    frames = as_frames(spark, *random_tables(7, False))
    empty = MonthRange(date(2021, 1, 1), date(2020, 1, 1))
    panel = org_month_panel(frames[0], frames[1], Spend(frames[2]), empty)
    found = panel.collect()
    assert len(found) == 9 == len({r.organization_id for r in found})
    assert {(r.the_month, float(r.available_balance)) for r in found} == {(None, 0.0)}
    segment = Segment("region_or_state", ("region_or_state",))
    summary = segment_month_summary(frames[0], frames[1], Spend(frames[2]), empty, segment)
    assert {(r.the_month, float(r.spend)) for r in summary.collect()} == {(None, 0.0)}
    assert sum(r.customers for r in summary.collect()) == 9


def test_null_text_in_a_segment_counts_as_empty(spark):
    rows = spark.createDataFrame([("a", None), (None, "b"), ("x", "y")], "p string, q string")
    found = rows.select(Segment("s", ("p", "q")).column()).collect()
    assert [r.s for r in found] == ["a-", "-b", "x-y"]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("group", [None, "g"])
def test_ranks_count_the_values_before(spark, group, descending):
    """A third of the rows tie on one value, as segments without spend do."""
    rng = random.Random(8)
    data = [
        (i, rng.choice(["x", "y"]), -99.0 if i % 3 == 0 else round(rng.gauss(0, 50), 1), rng.randint(0, 9))
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "id long, g string, v double, w long")
    ranks = [Rank("rv", "v", descending), Rank("rw", "w", descending)]
    found = {r.id: (r.rv, r.rw) for r in add_ranks(df, ranks, ("id",), group).collect()}
    sign = -1 if descending else 1
    for i, g, v, w in data[::37]:
        peers = [d for d in data if group is None or d[1] == g]
        want = tuple(1 + sum(sign * d[k] < sign * x for d in peers) for k, x in ((2, v), (3, w)))
        assert found[i] == want
    assert len(found) == len(data)


def test_null_values_groups_and_further_columns(spark):
    """A null ranks as the value that stands for it, and a null group is a group."""
    rows = [(1, None, 5.0, "a"), (2, None, None, None), (3, "g", None, "c"), (4, "g", -7.0, "d"), (5, None, 5.0, "e")]
    df = spark.createDataFrame(rows, "id int, g string, v double, rest string")
    found = add_ranks(df, [Rank("r", "v", missing=-99), Rank("d", "v", True)], ("id",), "g")
    assert found.columns == ["id", "g", "v", "rest", "r", "d"]
    assert sorted(map(tuple, found.collect())) == [
        (1, None, 5.0, "a", 2, 1), (2, None, None, None, 1, 3), (3, "g", None, "c", 1, 1),
        (4, "g", -7.0, "d", 2, 2), (5, None, 5.0, "e", 2, 1),
    ]


def test_index_of_ranks_is_that_of_the_components(spark):
    frames = as_frames(spark, *random_tables(12, True))
    books = Books(frames[0], frames[1], Spend(frames[2]), ACCOUNT_STUDY)
    for segment, weights in ((STATE, STATE_WEIGHTS), (STATE_INDUSTRY, STATE_INDUSTRY_WEIGHTS)):
        spec = ACCOUNT_STUDY.growth(weights)
        for keep in (None, ["CA", "UT", "CA-b2b"]):
            want = growth.final_index(books.index_components(segment, spec), segment.name, keep)
            assert sorted(map(tuple, books.growth_index(segment, spec, keep).collect()), key=repr) == sorted(
                map(tuple, want.collect()), key=repr
            )


def test_bitmaps_hold_every_date_once(spark):
    """Months of two centuries, days within a month, repeated and missing dates."""
    rng = random.Random(6)
    days = [date(1899 + k // 12, k % 12 + 1, rng.choice([1, 1, 1, 15, 28])) for k in range(0, 2400, 7)]
    rows = [(rng.choice(["a", "b", None]), rng.choice(days)) for _ in range(3000)] + [("a", None), (None, None)]
    df = spark.createDataFrame(rows, "organization_id string, the_month date")
    held = month_bitmaps(df, "organization_id")
    found = held.select("organization_id", F.explode(dates_held()).alias("d")).collect()
    assert len(found) == len(set(rows)) and set(map(tuple, found)) == set(rows)
    assert month_bitmaps(df.limit(0), "organization_id").count() == 0


@pytest.mark.parametrize("name", ["active_users", "active_region_counts"])
def test_no_row_of_an_organization_and_month_is_shuffled(spark, name):
    plan = retail.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_org = [line for line in plan.splitlines() if "Exchange hashpartitioning(organization_id" in line and "_span" in line]
    assert len(by_org) == 1
    assert not re.search(r"Exchange hashpartitioning\([^)]*organization_id[^)]*the_month", plan)


def test_ranges_follow_the_values(spark):
    values = sorted([-1e9, -99.0, -1.5, -1e-9, 0.0, 1e-9, 0.5, 0.5001, 1.0, 2.0, 1e6, 1e6 + 1, 1e15])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(value_range(F.col("v")), "v").orderBy("v").collect()]
    assert found == sorted(found) and found[0] < found[4] < found[-1]


def test_result_does_not_depend_on_row_order(spark):
    frames = as_frames(spark, *random_tables(9, True))
    segment = Segment("region_or_state", ("region_or_state",))

    def summary(balances, spend):
        found = segment_month_summary(frames[0], balances, Spend(spend), STUDIED, segment)
        return sorted(tuple(r) for r in found.collect())

    shuffled = frames[1].orderBy(F.rand(1)), frames[2].repartition(7)
    assert summary(frames[1], frames[2]) == summary(*shuffled)


ANCHOR_CASES = [
    ((2, 7), 11),
    ((3, 5), 11),  # the look-ahead of the first runs into the second
    ((2, 10), 4),  # the second looks past the end; the latest lies within the first's reach
    ((0, 9), 13),  # first anchor and latest lie outside the calendar
]


@pytest.mark.parametrize("anchors,latest", ANCHOR_CASES)
def test_months_read_give_the_ratios_of_the_full_calendar(spark, anchors, latest):
    frames = as_frames(spark, *random_tables(10, False))
    weights = AnchorWeights(Decimal("0.4"))
    spec = GrowthSpec(MONTHS[latest], {MONTHS[a]: weights for a in anchors}, horizons=(1, 2))
    segment = Segment("region_or_state", ("region_or_state",))

    def ratios(months):
        summary = segment_month_summary(
            frames[0], frames[1], Spend(frames[2]), months, segment, with_balance=False
        )
        return sorted(map(tuple, growth_ratios(summary, segment.name, spec).collect()))

    read = spec.months_read(STUDIED)
    assert read.count() < STUDIED.count()
    full = ratios(STUDIED)
    assert ratios(read) == full and full


def test_merged_ranges():
    def r(a, b):
        return MonthRange(MONTHS[a], MONTHS[b])

    merged = MonthRanges.merged([r(6, 8), r(0, 2), r(3, 4), r(7, 7), r(9, 5)])
    assert merged.ranges() == (r(0, 4), r(6, 8))
    assert merged.count() == 8 and MonthRanges.merged([]).count() == 0


def test_ranges_need_first_of_month_ends():
    with pytest.raises(ValueError):
        MonthRange(date(2020, 1, 15), date(2020, 3, 1))
    with pytest.raises(ValueError):
        MonthRange(date(2020, 1, 1), date(2020, 3, 31))


def test_rows_of_another_day_belong_to_no_month(spark):
    orgs = spark.createDataFrame([("o", "CA")], "organization_id string, region_or_state string")
    balances = spark.createDataFrame(
        [(date(2020, 1, 15), "o", "a", 5)],
        "the_month date, organization_id string, account_id string, available_balance long",
    )
    spend = spark.createDataFrame(
        [("o", date(2020, 1, 15), 7)],
        "organization_id string, the_month date, debit_card_spend_that_month long",
    )
    months = MonthRange(date(2020, 1, 1), date(2020, 3, 1))
    panel = org_month_panel(orgs, balances, Spend(spend), months).collect()
    assert sorted((r.the_month.month, r.available_balance, r.debit_card_spend_that_month) for r in panel) == [
        (1, 0, 0), (2, 0, 0), (3, 0, 0),
    ]
    segment = Segment("region_or_state", ("region_or_state",))
    found = segment_month_summary(orgs, balances, Spend(spend), months, segment).collect()
    assert sorted((r.the_month.month, r.balance, r.spend, r.customers) for r in found) == [
        (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1),
    ]
