from __future__ import annotations

import pytest

from monthweave.operators.calendar import MonthRange, calendar_spine
from monthweave.plans.settings import ACCOUNT_STUDY
from monthweave.schemas import BALANCES, CALENDAR, ORGANIZATIONS, SPENDING
from monthweave.sources.tables import append_rows, read_table, rows_of
from tests.conftest import BALANCE_ROWS, ORG_ROWS, SPEND_ROWS, month


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
@pytest.mark.parametrize(
    "table,rows", [(ORGANIZATIONS, ORG_ROWS), (BALANCES, BALANCE_ROWS), (SPENDING, SPEND_ROWS)]
)
def test_append_and_read_back(spark, tmp_path, table, rows, fmt):
    path = str(tmp_path / "t")
    options = {"header": "true"} if fmt == "csv" else {}
    df = rows_of(spark, table, rows)
    append_rows(df.limit(2), path, fmt, **options)
    append_rows(df.exceptAll(df.limit(2)), path, fmt, **options)
    back = read_table(spark, table, path, fmt)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in table.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_month_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "spend")
    append_rows(rows_of(spark, SPENDING, SPEND_ROWS), path, partition_by="the_month")
    back = read_table(spark, SPENDING, path)
    one = back.where(back.the_month == month("2020-09"))
    assert one.count() == 2 and back.count() == len(SPEND_ROWS)
    plan = one._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "the_month" in partition_filters


def test_calendar_round_trip(spark, tmp_path):
    path = str(tmp_path / "calendar")
    append_rows(calendar_spine(spark, ACCOUNT_STUDY.months), path)
    assert read_table(spark, CALENDAR, path).count() == 22


def test_null_in_a_required_column_is_refused(spark):
    with pytest.raises(Exception, match="(?i)null|none"):
        rows_of(spark, SPENDING, [("o1", month("2020-01"), None)]).collect()


def test_month_range_count():
    assert MonthRange(month("2019-12"), month("2020-02")).count() == 3
    assert MonthRange(month("2020-02"), month("2019-12")).count() == 0


@pytest.mark.parametrize("fmt, good, bad", [
    ("json", '{"organization_id": "o1", "the_month": "2020-01-01", "debit_card_spend_that_month": 1.5}', '{"organization_id": "o1", "the_month": "2020-01-01", "debit_card_spend_that_month": "x"}'),
    ("json", '{"organization_id": "o1", "the_month": "2020-01-01", "debit_card_spend_that_month": 1.5}', '{"organization_id": '),
    ("csv", "o1,2020-01-01,1.50", "o1,2020-01-01,x"),
])
def test_a_broken_row_fails_the_job(spark, tmp_path, fmt, good, bad):
    header = "organization_id,the_month,debit_card_spend_that_month\n" if fmt == "csv" else ""
    (tmp_path / "good").write_text(f"{header}{good}\n")
    assert read_table(spark, SPENDING, str(tmp_path / "good"), fmt).count() == 1
    (tmp_path / "bad").write_text(f"{header}{good}\n{bad}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, SPENDING, str(tmp_path / "bad"), fmt).collect()
