"""Registered queries: same rows as their SQL twins, and plans that scale."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as contract
from check_oracle import duckdb_rows, duckdb_tables, normalised
from monthweave.plans import retail, stored
from oracles.retail import oracle_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STORED = set(stored.queries())
NAMES = sorted({*retail.queries(), *STORED})


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(FOLDER)


def test_every_query_has_a_twin():
    assert set(NAMES) == set(oracle_sql())
    assert set(NAMES) <= set(contract.queries()) and set(NAMES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    columns, rows = duckdb_rows(con, contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert normalised(df.columns, df.collect()) == normalised(columns, rows)


def test_entry(spark):
    found = contract.entry(spark).collect()
    index = [r.overall_growth_index for r in found]
    assert len(found) == 10 and index == sorted(index, reverse=True)


def plan_of(spark, name: str) -> str:
    return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"Python|Pandas|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(spark, "growth_index_state")
    read = {s for s in re.findall(r"ReadSchema: struct<(.*?)>", plan)}
    assert "l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz" in read
    assert "c_custkey:bigint,c_nationkey:int" in read
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", plan)


@pytest.fixture
def shuffle_joins(spark):
    """Plans as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_order_lines_are_shuffled_once_on_their_link(spark, shuffle_joins):
    """Lines meet their owners, then shrink to segment and month: no shuffle of lines
    by organization. Both sides of the two large joins are plain shuffles, which is
    what AQE's skew split asks for."""
    plan = plan_of(spark, "state_month_summary")
    joins = re.findall(r"SortMergeJoin \[(\w+?)#\w+\], \[(\w+?)#\w+\]", plan)
    assert ("o_orderkey", "o_orderkey") in joins
    assert ("organization_id", "organization_id") in joins
    lines = plan[plan.index("SortMergeJoin [o_orderkey") :]
    after = [line.lstrip(" :+-") for line in lines.splitlines()[1:3]]
    assert after[0].startswith("Sort") and after[1].startswith("Exchange hashpartitioning(o_orderkey")
    owners = lines[lines.index("SortMergeJoin [organization_id") :]
    owners = owners[: owners.index("FileScan parquet [c_custkey")]
    assert len(re.findall(r"Exchange hashpartitioning\(organization_id#\w+, 4\)", owners)) == 2


def test_few_months_find_the_organization_first(spark, shuffle_joins):
    """The index reads a few months: orders are shuffled once and stay two columns wide."""
    plan = plan_of(spark, "growth_index_state")
    assert plan.index("SortMergeJoin [organization_id") < plan.index("SortMergeJoin [o_orderkey")


@pytest.mark.parametrize("name", sorted(set(NAMES) - STORED))
def test_building_a_query_starts_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", name)
    before = set(tracker.getJobIdsForGroup("building"))
    contract.queries()[name](spark, FOLDER)
    after = set(tracker.getJobIdsForGroup("building"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert after == before


def scans(spark, name: str, marker: str) -> int:
    """Scans of a table that are run, those behind a reused exchange counted once."""
    df = contract.queries()[name](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    return len(re.findall(rf"FileScan parquet \[[^\]]*{marker}", final))


@pytest.mark.parametrize("name", ["growth_index_state", "growth_index_state_industry"])
def test_ranks_read_the_lines_once(spark, shuffle_joins, name):
    assert scans(spark, name, "l_extendedprice") == 1


@pytest.mark.parametrize("name", ["org_month_panel", "state_month_summary"])
def test_balances_are_read_once(spark, shuffle_joins, name):
    assert scans(spark, name, "o_totalprice") == 1
