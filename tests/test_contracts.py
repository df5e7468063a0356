from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_oracle import duckdb_rows, duckdb_tables, normalised
from monthweave.operators.contracts import (
    contract_report,
    duplicate_keys,
    limit_violations,
    null_counts,
    null_rows,
    orphans,
)
from monthweave.schemas import BALANCES, ORGANIZATIONS, SPENDING
from tests.conftest import month, org_row


def loose(spark, table, rows):
    """Rows as files bring them: every column may be null, numbers are wider."""
    types = [
        (f.name, "decimal(20,2)" if f.dataType.typeName() == "decimal" else f.dataType.simpleString())
        for f in table.schema
    ]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in types))


@pytest.mark.parametrize("index,table", [(0, ORGANIZATIONS), (1, BALANCES), (2, SPENDING)])
def test_clean_tables_break_nothing(tables, index, table):
    df = tables[index]
    assert duplicate_keys(df, table.key, table.primary).count() == 0
    assert null_rows(df, table.required).count() == 0
    assert limit_violations(df, table.key, table.lengths, table.decimals).count() == 0
    report = contract_report(df, table).collect()
    assert len(report) == len(table.required) + 2 and {r.violations for r in report} == {0}


def test_primary_key(spark):
    orgs = loose(
        spark,
        ORGANIZATIONS,
        [
            org_row("o1", "b2b", "CA"),
            org_row("o1", "b2b", "UT"),
            org_row(None, "x", "CA"),
            org_row("o2", "x", "CA"),
        ],
    )
    found = duplicate_keys(orgs, ("organization_id",), primary=True).collect()
    assert {tuple(r) for r in found} == {("o1", 2), (None, 1)}


def test_unique_keys_ignore_nulls(spark):
    balances = loose(
        spark,
        BALANCES,
        [
            (month("2020-01"), "o1", "a1", Decimal("1.00")),
            (month("2020-01"), "o2", "a1", Decimal("2.00")),
            (month("2020-02"), "o1", "a1", Decimal("1.00")),
            (month("2020-02"), "o1", None, Decimal("1.00")),
            (month("2020-02"), "o1", None, Decimal("1.00")),
        ],
    )
    found = [tuple(r) for r in duplicate_keys(balances, BALANCES.key).collect()]
    assert found == [("a1", month("2020-01"), 2)]
    spend = loose(spark, SPENDING, [("o1", month("2020-01"), Decimal("1.00"))] * 3)
    assert [tuple(r) for r in duplicate_keys(spend, SPENDING.key).collect()] == [
        ("o1", month("2020-01"), 3)
    ]


def test_nulls(spark):
    rows = [org_row("o1", None, "CA"), org_row("o2", None, None), org_row("o3", "b2b", "CA")]
    orgs = loose(spark, ORGANIZATIONS, rows)
    counted = null_counts(orgs, "o", ORGANIZATIONS.required).collect()
    counts = {r.column_name: r.null_rows for r in counted}
    assert counts["industry"] == 2 and counts["region_or_state"] == 1
    assert sum(counts.values()) == 3 and "venture_capital_investors" not in counts
    broken = null_rows(orgs, ORGANIZATIONS.required).collect()
    assert {r.organization_id: r.null_columns for r in broken} == {"o1": ["industry"], "o2": ["industry", "region_or_state"]}


def test_every_required_column_is_checked(spark):
    for table, clean in (
        (BALANCES, (month("2020-01"), "o1", "a1", Decimal("1.00"))),
        (SPENDING, ("o1", month("2020-01"), Decimal("1.00"))),
    ):
        for i, name in enumerate(table.required):
            row = tuple(None if k == i else v for k, v in enumerate(clean))
            found = null_rows(loose(spark, table, [row, clean]), table.required).collect()
            assert [r.null_columns for r in found] == [[name]]


def test_lengths_and_ranges(spark):
    orgs = loose(spark, ORGANIZATIONS, [org_row("o1", "b2b", "CAL"), org_row("o2", "b2b", "CA")])
    found = limit_violations(orgs, ("organization_id",), ORGANIZATIONS.lengths).collect()
    assert [tuple(r) for r in found] == [("o1", "region_or_state", "varchar(2)", "CAL")]
    balances = loose(
        spark,
        BALANCES,
        [
            (month("2020-01"), "o1", "a1", Decimal("99999999.99")),
            (month("2020-01"), "o1", "a2", Decimal("100000000.00")),
            (month("2020-01"), "o1", "a3", None),
        ],
    )
    found = limit_violations(balances, BALANCES.key, BALANCES.lengths, BALANCES.decimals).collect()
    assert [(r.account_id, r.column_name, r.declared) for r in found] == [
        ("a2", "available_balance", "numeric(10,2)")
    ]


def test_report_counts_each_rule(spark):
    spend = loose(
        spark,
        SPENDING,
        [("o1", month("2020-01"), Decimal("1.00"))] * 2 + [("o2", month("2020-01"), None)],
    )
    report = {r.rule: r.violations for r in contract_report(spend, SPENDING).collect()}
    assert report["unique organization_id, the_month"] == 1
    assert report["not null debit_card_spend_that_month"] == 1
    assert report["declared lengths and ranges"] == 0


def test_orphans(spark, tables):
    orgs, balances, spend = tables
    assert orphans(balances, orgs, "organization_id").count() == 0
    rows = [(o, month("2020-01"), Decimal("1.00")) for o in ("o1", "o8", "o8", "o9", None)]
    found = orphans(loose(spark, SPENDING, rows), orgs, "organization_id").collect()
    assert {tuple(r) for r in found} == {("o8", 2), ("o9", 1)}


def test_facts_of_missing_customers_are_reported(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for table in ("nation", "region", "customer", "orders", "lineitem"):
        df = spark.read.parquet(f"{source}/{table}.parquet")
        if table == "customer":
            df = df.where("c_custkey % 10 <> 1")
        if table == "orders":
            nobody = F.when(F.col("o_orderkey") % 7 != 2, F.col("o_custkey"))
            df = df.withColumn("o_custkey", nobody)
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    df = contract.queries()["check_orphans"](spark, str(tmp_path))
    found = df.collect()
    assert {r.table_name for r in found} == {"balances", "spend"}
    assert all(r.organization_id % 10 == 1 for r in found)
    columns, rows = duckdb_rows(duckdb_tables(str(tmp_path)), contract.oracle_sql()["check_orphans"])
    assert normalised(df.columns, found) == normalised(columns, rows)
