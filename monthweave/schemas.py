"""Declared tables: schemas, keys and column limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ORG_ID = "organization_id"
MONTH = "the_month"
ACCOUNT_ID = "account_id"
BALANCE = "available_balance"
SPEND = "debit_card_spend_that_month"
REGION = "region_or_state"
INDUSTRY = "industry"


@dataclass(frozen=True)
class TableContract:
    """What a table promises: its columns, its key and the limits on its values.

    A primary key may not hold nulls. A unique key may, and rows with a null in
    it never clash. ``lengths`` limits text columns, ``decimals`` gives
    (precision, scale) of number columns.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    primary: bool = False
    lengths: dict[str, int] = field(default_factory=dict)
    decimals: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema.fields if not f.nullable)


# Column names, types and limits of the four tables.
ORGANIZATIONS = TableContract(
    name="organization_data",
    schema=T.StructType(
        [
            T.StructField(ORG_ID, T.StringType(), False),
            T.StructField(INDUSTRY, T.StringType(), False),
            T.StructField("has_foreign_founder", T.StringType(), False),
            T.StructField("has_us_founder", T.StringType(), False),
            T.StructField("company_structure", T.StringType(), False),
            T.StructField("venture_capital_investors", T.StringType(), True),
            T.StructField(REGION, T.StringType(), False),
            T.StructField("country", T.StringType(), False),
        ]
    ),
    key=(ORG_ID,),
    primary=True,
    lengths={
        ORG_ID: 36,
        INDUSTRY: 34,
        "has_foreign_founder": 5,
        "has_us_founder": 5,
        "company_structure": 23,
        "venture_capital_investors": 55,
        REGION: 2,
        "country": 2,
    },
)

BALANCES = TableContract(
    name="monthly_account_balances",
    schema=T.StructType(
        [
            T.StructField(MONTH, T.DateType(), False),
            T.StructField(ORG_ID, T.StringType(), False),
            T.StructField(ACCOUNT_ID, T.StringType(), False),
            T.StructField(BALANCE, T.DecimalType(10, 2), False),
        ]
    ),
    key=(ACCOUNT_ID, MONTH),
    lengths={ORG_ID: 36, ACCOUNT_ID: 36},
    decimals={BALANCE: (10, 2)},
)

SPENDING = TableContract(
    name="monthly_debit_card_spend",
    schema=T.StructType(
        [
            T.StructField(ORG_ID, T.StringType(), False),
            T.StructField(MONTH, T.DateType(), False),
            T.StructField(SPEND, T.DecimalType(9, 2), False),
        ]
    ),
    key=(ORG_ID, MONTH),
    lengths={ORG_ID: 36},
    decimals={SPEND: (9, 2)},
)

CALENDAR = TableContract(
    name="calendar_table",
    schema=T.StructType([T.StructField(MONTH, T.DateType(), False)]),
    key=(),
)
