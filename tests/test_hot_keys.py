"""One customer holds a third of the orders and one order a third of the lines."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_oracle import duckdb_rows, duckdb_tables, normalised
from monthweave.operators.panel import summarise_panel
from monthweave.operators.ranking import Rank, add_ranks
from monthweave.operators.spend import Spend
from monthweave.plans.books import Books
from monthweave.plans.settings import ACCOUNT_STUDY, STATE

SMALL_SPLITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest test tables, forty times over, with the hot keys put in."""
    source, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("hot"))
    copies = spark.range(40).withColumnRenamed("id", "copy")

    def copied(table):
        return spark.read.parquet(f"{source}/{table}.parquet").join(F.broadcast(copies))

    for table in ("nation", "region"):
        spark.read.parquet(f"{source}/{table}.parquet").write.parquet(f"{out}/{table}.parquet")
    customers = copied("customer").withColumn("c_custkey", F.expr("c_custkey + copy * 150"))
    orders = copied("orders").withColumn("o_orderkey", F.expr("o_orderkey + copy * 1500"))
    orders = orders.withColumn(
        "o_custkey", F.expr("if(o_orderkey % 3 = 0, 7, o_custkey + copy * 150)")
    )
    lines = copied("lineitem").withColumn(
        "l_orderkey",
        F.expr("if(hash(l_orderkey, l_linenumber, copy) % 3 = 0, 11, l_orderkey + copy * 1500)"),
    )
    for table, df in (("customer", customers), ("orders", orders), ("lineitem", lines)):
        df.drop("copy").repartition(8).write.parquet(f"{out}/{table}.parquet")
    return out


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_SPLITS}
    for key, value in SMALL_SPLITS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "name,split_joins",
    [
        ("state_month_summary", 2),
        ("growth_index_state_industry", 2),
        ("org_month_panel", 1),
        ("active_region_share", 1),
        ("industry_totals", 0),
        ("monthly_spend_total", 0),
    ],
)
def test_hot_keys_are_split_and_nothing_is_lost(spark, folder, small_splits, name, split_joins):
    df = contract.queries()[name](spark, folder)
    found = normalised(df.columns, df.collect())
    columns, rows = duckdb_rows(duckdb_tables(folder), contract.oracle_sql()[name])
    assert found == normalised(columns, rows)
    assert len(re.findall("skew=true", final_plan(df))) >= split_joins


def test_no_task_holds_a_third_of_the_segments_that_tie(spark, small_splits):
    """Missing ratios tie on one value, which is one row for each task before it is ordered."""
    size = 60_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    segments = spark.range(0, size, 1, 8).selectExpr(
        "concat('a rather long name of segment ', id) AS segment",
        "if(id % 3 = 0, null, (id * 7919 % 10007) / 100.0) AS ratio",
        "cast(id % 5 AS decimal(9,2)) AS spend",
    )
    ranks = [Rank("rank_ratio", "ratio", missing=-99), Rank("rank_spend", "spend", descending=True)]
    df = add_ranks(segments, ranks, ("segment",))
    try:
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = final_plan(df)
    assert "skew=true" in plan
    # What is ordered was counted by value first.
    assert "Window [sum(_rows" in plan and "Window [rank" not in plan
    assert re.search(r"HashAggregate\(keys=[^\n]*range[^\n]*partial_count\(1\)", plan)

    ratios = sorted(-99.0 if r.ratio is None else float(r.ratio) for r in rows)
    first = {}
    for place, value in enumerate(ratios, 1):
        first.setdefault(value, place)
    assert len(rows) == size
    for r in rows:
        assert r.rank_ratio == first[-99.0 if r.ratio is None else float(r.ratio)]
        assert r.rank_spend == 1 + (4 - int(r.spend)) * size // 5


def test_an_organization_with_a_third_of_all_accounts_is_split(spark, small_splits):
    """Its panel rows alone outnumber everybody else's, in one month even."""
    balances = spark.range(0, 90_000, 1, 8).select(
        F.expr("if(id % 3 = 0 or id % 10 = 1, date'2019-09-01', date'2019-08-01') AS the_month"),
        F.expr("if(id % 3 = 0, 'hot', concat('o', id % 500)) AS organization_id"),
        F.expr("concat('a', id) AS account_id"),
        F.expr("cast((hash(id) % 1000000) / 100.0 AS decimal(10,2)) AS available_balance"),
    )
    spend = spark.range(500).select(
        F.expr("if(id = 0, 'hot', concat('o', id)) AS organization_id"),
        F.expr("date'2019-09-01' AS the_month"),
        F.expr("cast(id + 1 AS decimal(9,2)) AS debit_card_spend_that_month"),
    )
    orgs = spark.range(501).select(
        F.expr("if(id = 500, 'hot', concat('o', id)) AS organization_id"),
        F.expr("'b2b' AS industry"),
        F.expr("if(id % 2 = 0, 'CA', 'UT') AS region_or_state"),
    )
    books = Books(orgs, balances, Spend(spend), ACCOUNT_STUDY)
    panel = books.org_month_panel()
    found = panel.collect()
    assert "skew=true" in final_plan(panel)

    keys = balances.select("organization_id", "the_month", "available_balance")
    held = {tuple(r) for r in keys.collect()}
    with_balance = {(org, month) for org, month, _ in held}
    assert len(found) == len(held) + 501 * 22 - len(with_balance)
    rows = {(r.organization_id, r.the_month, r.available_balance) for r in found}
    assert len(rows) == len(found) and held <= rows
    repeats = sum(1 for r in found if r.organization_id == "hot" and r.debit_card_spend_that_month == 1)
    assert repeats == sum(1 for org, month, _ in held if org == "hot" and month.month == 9) > 25_000

    summary = books.month_summary(STATE)
    rolled = summarise_panel(panel, STATE).select(summary.columns)
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, rolled.collect()))
