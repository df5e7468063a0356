from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from monthweave import build_session  # noqa: E402
from monthweave.operators.spend import Spend  # noqa: E402
from monthweave.plans.books import Books  # noqa: E402
from monthweave.plans.settings import ACCOUNT_STUDY  # noqa: E402
from monthweave.schemas import BALANCES, ORGANIZATIONS, SPENDING  # noqa: E402
from monthweave.sources.tables import rows_of  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(text: str) -> date:
    year, number = text.split("-")
    return date(int(year), int(number), 1)


def org_row(org: str, industry: str, region: str) -> tuple:
    return (org, industry, "false", "true", "LLC", None, region, "US")


# Small tables that hold every special case: o1 has two accounts with different
# balances, o2 two with equal balances, o4 a lower-case region, o5 no facts.
ORG_ROWS = [
    org_row("o1", "b2b", "CA"),
    org_row("o2", "b2b", "CA"),
    org_row("o3", "media", "UT"),
    org_row("o4", "media", "ca"),
    org_row("o5", "crypto", "WY"),
]
BALANCE_ROWS = [
    (month("2019-08"), "o1", "a1", Decimal("100.00")),
    (month("2019-09"), "o1", "a1", Decimal("100.00")),
    (month("2019-09"), "o1", "a2", Decimal("250.00")),
    (month("2019-09"), "o2", "a3", Decimal("5.00")),
    (month("2019-09"), "o2", "a4", Decimal("5.00")),
    (month("2019-09"), "o3", "a5", Decimal("300.00")),
]
SPEND_ROWS = [
    ("o1", month("2019-09"), Decimal("10.00")),
    ("o1", month("2019-10"), Decimal("20.00")),
    ("o1", month("2019-11"), Decimal("40.00")),
    ("o1", month("2021-01"), Decimal("8.00")),
    ("o2", month("2019-09"), Decimal("6.00")),
    ("o2", month("2020-09"), Decimal("4.00")),
    ("o2", month("2020-10"), Decimal("9.00")),
    ("o3", month("2019-09"), Decimal("30.00")),
    ("o3", month("2019-12"), Decimal("60.00")),
    ("o3", month("2020-09"), Decimal("5.00")),
    ("o4", month("2019-10"), Decimal("7.00")),
]


@pytest.fixture(scope="session")
def tables(spark):
    return (
        rows_of(spark, ORGANIZATIONS, ORG_ROWS),
        rows_of(spark, BALANCES, BALANCE_ROWS),
        rows_of(spark, SPENDING, SPEND_ROWS),
    )


@pytest.fixture(scope="session")
def books(tables):
    orgs, balances, spend = tables
    return Books(orgs, balances, Spend(spend), ACCOUNT_STUDY)
