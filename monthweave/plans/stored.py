"""Questions over facts that are stored first, in the layout that suits them.

Storing runs a job when such a query is built; each stores its tables anew in the shared folder. The
tables stay there until the folder is emptied, as a checkpoint would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthweave.functions.money import as_doubles
from monthweave.operators.key_index import KeyIndex
from monthweave.operators.spend import Spend
from monthweave.plans.books import Books
from monthweave.plans.retail import RetailBooks
from monthweave.plans.settings import RETAIL_STUDY
from monthweave.schemas import BALANCE, MONTH, ORG_ID, SPEND
from monthweave.sources.retail import RetailTables
from monthweave.sources.shared import new_folder
from monthweave.sources.tables import Buckets, append_rows, read_buckets, stored_month_bounds

#: Buckets of orders and lines; on a cluster so many that one fits into a task.
FACT_BUCKETS = 16
#: The column whose row names the month of the leaders.
LEADER_MONTH = "leader_month"


def bucketed(tables: RetailTables, folder: str, buckets: int = FACT_BUCKETS) -> RetailTables:
    """The same tables with orders and lines stored in ``folder``, both bucketed by the order."""
    stored = {}
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        df, dealt = tables.read(name), Buckets((key,), buckets)
        append_rows(df, f"{folder}/{name}", buckets=dealt)
        stored[name] = read_buckets(tables.spark, df.schema, f"{folder}/{name}", dealt)
    return replace(tables, stored=stored)


def org_month_panel_bucketed(tables: RetailTables) -> DataFrame:
    """Lines meet their orders bucket by bucket; sums by organization and month are all that is shuffled of them."""
    facts = bucketed(tables, new_folder(tables.spark, "bucketed"))
    panel = RetailBooks(facts, with_country=True).org_month_panel()
    return as_doubles(panel, (BALANCE, SPEND))


def by_month(tables: RetailTables, folder: str) -> tuple[DataFrame, DataFrame]:
    """Balances and spend, one row for each key, stored by month."""
    facts = (("balances", tables.balances()), ("spend", tables.spend().table()))
    for name, df in facts:
        append_rows(df, f"{folder}/{name}", partition_by=MONTH)
    read = lambda name, df: tables.spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    balances, spend = (read(*fact) for fact in facts)
    return balances, spend


def industry_totals_by_parameter(tables: RetailTables) -> DataFrame:
    """The month is read from a table when the question runs, and only its facts are read."""
    spark, folder = tables.spark, new_folder(tables.spark, "by-month")
    balances, spend = by_month(tables, folder)
    rows = [(LEADER_MONTH, RETAIL_STUDY.leader_month), ("latest_month", RETAIL_STUDY.latest)]
    append_rows(spark.createDataFrame(rows, f"name string, {MONTH} date"), f"{folder}/parameters")
    wanted = spark.read.parquet(f"{folder}/parameters").where(F.col("name") == LEADER_MONTH)
    books = Books(tables.organizations(), balances, Spend(spend), RETAIL_STUDY, cents=True)
    return as_doubles(books.industry_totals_at(wanted), ("total_balance", "total_spend"))


def month_bounds_stored(tables: RetailTables) -> DataFrame:
    """From the footers of the stored files, where the session allows it."""
    folder = new_folder(tables.spark, "movements")
    append_rows(tables.balance_lines().select(MONTH, ORG_ID, BALANCE), folder)
    return stored_month_bounds(tables.spark, folder)


def movements_across_batches(tables: RetailTables) -> DataFrame:
    """Organizations with several movements of one day, when orders of odd keys come after the others."""
    orders, _ = tables.dated().orders_and_lines()
    key = T.StructType([f for f in orders.schema.fields if f.name in (ORG_ID, MONTH)])
    index = KeyIndex(tables.spark, new_folder(tables.spark, "keys"), key, FACT_BUCKETS)
    late = F.col("o_orderkey") % 2 == 1
    index.add(orders.where(~late), "first")
    return index.add(orders.where(late), "late")


STORED_QUERIES: dict[str, Callable[[RetailTables], DataFrame]] = {
    "org_month_panel_bucketed": org_month_panel_bucketed,
    "industry_totals_by_parameter": industry_totals_by_parameter,
    "month_bounds_stored": month_bounds_stored,
    "check_movements_across_batches": movements_across_batches,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    over = lambda query: lambda spark, folder: query(RetailTables(spark, folder))
    return {name: over(query) for name, query in STORED_QUERIES.items()}
