"""Every question over the order tables, by name; amounts come out as doubles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.functions.money import as_doubles, with_decimals
from monthweave.operators import activity, calendar, contracts
from monthweave.operators.calendar import Months
from monthweave.operators.panel import Segment
from monthweave.operators.spend import Spend
from monthweave.plans.books import Books
from monthweave.plans.settings import (
    RETAIL_STUDY,
    STATE,
    STATE_INDUSTRY,
    STATE_INDUSTRY_WEIGHTS,
    STATE_WEIGHTS,
)
from monthweave.schemas import ACCOUNT_ID, BALANCE, INDUSTRY, MONTH, ORG_ID, REGION, SPEND
from monthweave.sources.retail import RetailTables, with_account_id

Query = Callable[[SparkSession, str], DataFrame]


class RetailBooks(Books):
    """Books over the order tables, each table set up when a question first needs it."""

    def __init__(self, tables: RetailTables, with_country: bool = False):
        self._tables = tables
        self._with_country = with_country
        self.study = RETAIL_STUDY
        self.cents = True

    def facts(self, months: Months, few: bool = False) -> tuple[DataFrame, Spend]:
        """Limited at the scan. An order has a few lines, so the lines of the whole calendar
        outnumber the orders, those of a few months do not."""
        spend = replace(self._tables.spend(months), owners_first=not few)
        return self._tables.balances(months), spend

    def active_region_counts(self) -> DataFrame:
        """Orders are movements and owners of lines at once, so they are read once."""
        orders, lines = self._tables.orders_and_lines()
        return activity.linked_region_counts(
            orders, lines, "o_orderkey", self.organizations, self.study.share_region
        )

    @cached_property
    def organizations(self) -> DataFrame:
        return self._tables.organizations(self._with_country)

    @cached_property
    def balances(self) -> DataFrame:
        return self._tables.balances()

    @cached_property
    def movements(self) -> DataFrame:
        return self._tables.balance_lines()

    @cached_property
    def spend(self) -> Spend:
        return self._tables.spend()


def _spell_out(df: DataFrame, *amounts: str) -> DataFrame:
    return as_doubles(with_decimals(df, amounts), amounts)


def _nulls(t: RetailTables) -> DataFrame:
    """Counted on the rows as they are read: a sum would hide a null beside an amount."""
    lines = with_account_id(t.balance_lines())
    parts = (
        (t.organizations(with_country=True), "organizations", (ORG_ID, INDUSTRY, REGION, "country")),
        (lines, "balances", (MONTH, ORG_ID, ACCOUNT_ID, BALANCE)),
        (t.spend().by_org(), "spend", (ORG_ID, MONTH, SPEND)),
        (RetailBooks(t).calendar_spine(), "calendar", (MONTH,)),
    )
    return reduce(DataFrame.unionByName, [contracts.null_counts(*p) for p in parts])


def _violations(df: DataFrame, table: str, key: tuple[str, ...], **limits) -> DataFrame:
    """Violations of any table under the same columns."""
    row_key = F.concat_ws(" ", *[F.col(k).cast("string") for k in key]).alias("row_key")
    found = contracts.limit_violations(df, key, **limits)
    return found.select(F.lit(table).alias("table_name"), row_key, "column_name", "declared", "value")


# Tighter than the data, so that these checks do report rows.
TEXT_LIMIT, ACCOUNT_LIMIT, AMOUNT_LIMIT = 8, 5, (8, 2)


def _lengths(t: RetailTables) -> DataFrame:
    texts = dict.fromkeys((INDUSTRY, REGION, "country"), TEXT_LIMIT)
    orgs = _violations(t.organizations(with_country=True), "organizations", (ORG_ID,), lengths=texts)
    accounts = _violations(
        t.balances(), "balances", (ACCOUNT_ID, MONTH), lengths={ACCOUNT_ID: ACCOUNT_LIMIT}
    )
    return orgs.unionByName(accounts)


def _amounts_in_range(t: RetailTables) -> DataFrame:
    balances = with_decimals(t.balances(), (BALANCE,))
    spend = with_decimals(t.spend().table(), (SPEND,))
    found = _violations(balances, "balances", (ACCOUNT_ID, MONTH), decimals={BALANCE: AMOUNT_LIMIT})
    return found.unionByName(
        _violations(spend, "spend", (ORG_ID, MONTH), decimals={SPEND: AMOUNT_LIMIT})
    )


def _off_calendar(t: RetailTables) -> DataFrame:
    days = t.dated()
    return contracts.off_calendar(days.balance_lines(), "balances", MONTH).unionByName(
        contracts.off_calendar(days.spend().rows, "spend", MONTH)
    )


def _orphans(t: RetailTables) -> DataFrame:
    """Of both whole tables of facts, whatever the month."""
    facts = (("balances", t.balance_lines()), ("spend", t.spend().by_org()))
    found = [
        contracts.orphans(df, t.organizations(), ORG_ID).select(
            F.lit(table).alias("table_name"), ORG_ID, "n_rows"
        )
        for table, df in facts
    ]
    return reduce(DataFrame.unionByName, found)


def _duplicate_balance_lines(t: RetailTables) -> DataFrame:
    return contracts.duplicate_keys(with_account_id(t.balance_lines()), (ACCOUNT_ID, MONTH))


TABLE_QUERIES: dict[str, Callable[[RetailTables], DataFrame]] = {
    "scan_organizations": lambda t: t.organizations(with_country=True),
    "scan_balances": lambda t: _spell_out(t.balances(), BALANCE),
    "scan_spend": lambda t: _spell_out(t.spend().table(), SPEND),
    "month_bounds_balances": lambda t: calendar.month_bounds(t.dated().balance_lines(), rounded=True),
    "month_bounds_spend": lambda t: calendar.month_bounds(t.dated().spend().rows, rounded=True),
    "calendar_spine": lambda t: RetailBooks(t).calendar_spine(),
    "monthly_balance_total": lambda t: as_doubles(
        RetailBooks(t).monthly_balance_total(), ("total_balance",)
    ),
    "monthly_spend_total": lambda t: as_doubles(
        RetailBooks(t).monthly_spend_total(), ("total_spend",)
    ),
    "industry_totals": lambda t: as_doubles(
        RetailBooks(t).industry_totals(), ("total_balance", "total_spend")
    ),
    "industry_leaders": lambda t: RetailBooks(t).industry_leaders(),
    "active_users": lambda t: RetailBooks(t).active_users(),
    "active_region_counts": lambda t: RetailBooks(t).active_region_counts(),
    "active_region_share": lambda t: RetailBooks(t).active_region_share(),
    # The spend of a segment's month over its balance, as a chart of both would show it.
    "state_spend_over_balance": lambda t: as_doubles(
        RetailBooks(t).spend_over_balance(STATE), ("balance", "spend")
    ),
    "top_states_by_average_balance": lambda t: as_doubles(
        RetailBooks(t).top_average_balances(STATE), ("balance",)
    ),
    "org_month_panel": lambda t: as_doubles(
        RetailBooks(t, with_country=True).org_month_panel(), (BALANCE, SPEND)
    ),
    # Accounts summed first, so that spend counts once.
    "org_month_panel_once": lambda t: as_doubles(
        RetailBooks(t, with_country=True).org_month_panel(pre_aggregate=True), (BALANCE, SPEND)
    ),
    "state_month_summary_once": lambda t: as_doubles(
        RetailBooks(t).month_summary(STATE, pre_aggregate=True), ("balance", "spend")
    ),
    # Days instead of months: only what is dated the first of a month counts.
    "org_month_panel_dated": lambda t: as_doubles(
        RetailBooks(t.dated(), with_country=True).org_month_panel(), (BALANCE, SPEND)
    ),
    "state_month_summary_dated": lambda t: as_doubles(
        RetailBooks(t.dated()).month_summary(STATE), ("balance", "spend")
    ),
    "growth_index_state": lambda t: as_doubles(
        RetailBooks(t).growth_index_state(), ("latest_spend", "overall_growth_index")
    ),
    "growth_index_state_industry": lambda t: as_doubles(
        RetailBooks(t).growth_index_state_industry(), ("latest_spend", "overall_growth_index")
    ),
    "cohort_usage": lambda t: as_doubles(
        RetailBooks(t).cohort_usage(), [f"spend_{k}" for k in range(7)]
    ),
    "cohort_month3_trend": lambda t: as_doubles(RetailBooks(t).cohort_trend(3), ("spend",)),
    "state_industry_sparse_forward_spend": lambda t: as_doubles(
        RetailBooks(t).sparse_forward_spend(STATE_INDUSTRY), ("spend", "fwd2_spend", "fwd4_spend")
    ),
    "check_org_pk": lambda t: contracts.duplicate_keys(t.organizations(), (ORG_ID,), primary=True),
    # Rows of one day, before anything is summed.
    "check_balance_unique": lambda t: _duplicate_balance_lines(t.dated()),
    "check_spend_unique": lambda t: contracts.duplicate_keys(t.dated().spend().by_org(), (ORG_ID, MONTH)),
    "check_balance_lines_unique": _duplicate_balance_lines,
    "check_spend_lines_unique": lambda t: contracts.duplicate_keys(t.spend().by_org(), (ORG_ID, MONTH)),
    "check_nulls": _nulls,
    "check_lengths": _lengths,
    "check_amounts": _amounts_in_range,
    "check_first_of_month": _off_calendar,
    "check_orphans": _orphans,
}


def _segment_queries(prefix: str, segment: Segment, weights) -> dict:
    spec = RETAIL_STUDY.growth(weights)
    return {
        f"{prefix}_month_summary": lambda t: as_doubles(
            RetailBooks(t).month_summary(segment), ("balance", "spend")
        ),
        f"{prefix}_forward_spend": lambda t: as_doubles(
            RetailBooks(t).forward_spend(segment), ("balance", "spend", "fwd2_spend", "fwd4_spend")
        ),
        f"{prefix}_anchor_averages": lambda t: as_doubles(
            RetailBooks(t).anchor_averages(segment), ("spend",)
        ),
        f"{prefix}_latest_spend": lambda t: as_doubles(
            RetailBooks(t).latest_spend(segment), ("latest_spend",)
        ),
        f"{prefix}_growth_ratios": lambda t: as_doubles(
            RetailBooks(t).growth_ratios(segment, spec), ("latest_spend",)
        ),
        f"{prefix}_growth_ranks": lambda t: as_doubles(
            RetailBooks(t).growth_ranks(segment, spec), ("latest_spend",)
        ),
        f"{prefix}_index_components": lambda t: as_doubles(
            RetailBooks(t).index_components(segment, spec), ("latest_spend", "growth_index")
        ),
    }


TABLE_QUERIES |= _segment_queries("state", STATE, STATE_WEIGHTS)
TABLE_QUERIES |= _segment_queries("state_industry", STATE_INDUSTRY, STATE_INDUSTRY_WEIGHTS)


def _over_folder(query: Callable[[RetailTables], DataFrame]) -> Query:
    return lambda spark, folder: query(RetailTables(spark, folder))


def queries() -> dict[str, Query]:
    return {name: _over_folder(query) for name, query in TABLE_QUERIES.items()}
