"""The questions asked of one set of books: organizations, balances and spend."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.functions.columns import ratio
from monthweave.functions.money import with_decimals
from monthweave.operators import activity, calendar, cohorts, growth, panel, totals
from monthweave.operators.calendar import MonthRange, Months
from monthweave.operators.growth import GrowthSpec
from monthweave.operators.panel import Segment
from monthweave.operators.spend import Spend
from monthweave.plans.settings import (
    STATE,
    STATE_INDUSTRY,
    STATE_INDUSTRY_WEIGHTS,
    STATE_WEIGHTS,
    Study,
)
from monthweave.schemas import BALANCE, INDUSTRY, MONTH, SPEND


class Books:
    """Three tables and the study asked of them.

    ``cents`` says that amounts are whole minor units; results then come back as
    decimals. With decimal amounts leave it False. Totals and distincts are the
    same over ``movements`` (rows that add up to the balances) and then skip the
    sum per account; by default they read the balances.
    """

    def __init__(
        self,
        organizations: DataFrame,
        balances: DataFrame,
        spend: Spend,
        study: Study,
        cents: bool = False,
        movements: DataFrame | None = None,
    ):
        self.organizations = organizations
        self.balances = balances
        self.spend = spend
        self.study = study
        self.cents = cents
        self.movements = balances if movements is None else movements

    def facts(self, months: Months, few: bool = False) -> tuple[DataFrame, Spend]:
        """Balances and spend of at least ``months``; operators filter what they read.

        ``few`` says that the question reads a small part of the calendar.
        """
        return self.balances, self.spend

    def _amounts(self, df: DataFrame, *columns: str) -> DataFrame:
        return with_decimals(df, columns) if self.cents else df

    def calendar_spine(self) -> DataFrame:
        return calendar.spine_over([self.movements, self.spend.rows])

    def monthly_balance_total(self) -> DataFrame:
        return self._amounts(
            totals.monthly_total(self.movements, BALANCE, "total_balance"), "total_balance"
        )

    def monthly_spend_total(self) -> DataFrame:
        return self._amounts(
            totals.monthly_total(self.spend.rows, SPEND, "total_spend"), "total_spend"
        )

    def industry_totals_at(self, parameter: DataFrame) -> DataFrame:
        """At the month that a relation holds when the question runs."""
        found = totals.segment_totals(
            self.organizations, self.balances, self.spend.by_org(), INDUSTRY, parameter
        )
        return self._amounts(found, "total_balance", "total_spend")

    def industry_totals(self) -> DataFrame:
        month = self.study.leader_month
        balances, spend = self.facts(MonthRange(month, month), few=True)
        found = totals.segment_totals(
            self.organizations, balances, spend.by_org(), INDUSTRY, month
        )
        return self._amounts(found, "total_balance", "total_spend")

    def industry_leaders(self) -> DataFrame:
        return totals.leaders(self.industry_totals(), INDUSTRY)

    def active_users(self) -> DataFrame:
        return activity.active_users(self.movements, self.spend)

    def active_region_counts(self) -> DataFrame:
        return activity.active_region_counts(
            self.movements, self.spend, self.organizations, self.study.share_region
        )

    def active_region_share(self) -> DataFrame:
        return activity.active_region_share(self.active_region_counts())

    def org_month_panel(
        self, attributes: Sequence[str] | None = None, pre_aggregate: bool = False
    ) -> DataFrame:
        """With ``pre_aggregate`` accounts are summed first: one row a month, spend counted once."""
        months = self.study.months
        balances, spend = self.facts(months)
        balances = panel.total_balances(balances) if pre_aggregate else balances
        rows = panel.org_month_panel(self.organizations, balances, spend, months, attributes)
        return self._amounts(rows, BALANCE, SPEND)

    def month_summary(
        self,
        segment: Segment,
        with_balance: bool = True,
        months: Months | None = None,
        pre_aggregate: bool = False,
    ) -> DataFrame:
        """With ``pre_aggregate`` accounts are summed first, so that spend counts once."""
        few = months is not None
        months = self.study.months if months is None else months
        balances, spend = self.facts(months, few)
        balances = panel.total_balances(balances) if pre_aggregate else balances
        summary = panel.segment_month_summary(
            self.organizations, balances, spend, months, segment, with_balance
        )
        return self._amounts(summary, *(["balance"] if with_balance else []), "spend")

    def spend_over_balance(self, segment: Segment) -> DataFrame:
        """Spend per unit of balance by segment and month, null without a balance."""
        return self.month_summary(segment).select(
            segment.name, MONTH, "balance", "spend",
            ratio(F.col("spend"), F.col("balance")).alias("spend_over_balance"),
        )

    def top_average_balances(self, segment: Segment, top: int = 5) -> DataFrame:
        """The segments of the largest balance per organization in the latest month, best first.

        Equal averages are put in the order of their names.
        """
        latest = self.study.latest
        summary = self.month_summary(segment, months=MonthRange(latest, latest))
        average = ratio(F.col("balance"), F.col("customers")).alias("average_balance")
        return (
            summary.select(segment.name, "balance", "customers", average)
            .orderBy(F.col("average_balance").desc_nulls_last(), segment.name)
            .limit(top)
        )

    def forward_spend(self, segment: Segment) -> DataFrame:
        return growth.forward_sums(self.month_summary(segment), segment.name)

    def sparse_forward_spend(self, segment: Segment) -> DataFrame:
        """Over the months with spend alone; those without are not there."""
        summary = self.month_summary(segment, with_balance=False).where(F.col("spend") != 0)
        return growth.forward_sums(summary, segment.name, gaps=True)

    def cohort_usage(self, offsets: Sequence[int] = tuple(range(7))) -> DataFrame:
        months = cohorts.cohort_months(self.movements, self.spend)
        usage = self._amounts(
            cohorts.cohort_usage(months, offsets, self.study.months.last), *(f"spend_{k}" for k in offsets)
        )
        return cohorts.spend_per_org(usage, offsets)

    def cohort_trend(self, offset: int = 3) -> DataFrame:
        """Usage in one month of the cohorts' lives, month 3 unless said otherwise."""
        return cohorts.cohort_trend(self.cohort_usage((offset,)), offset)

    def anchor_averages(
        self, segment: Segment, horizons: Sequence[int] = (2, 4)
    ) -> DataFrame:
        """Reads only the anchors and the months they look ahead to."""
        months = growth.anchor_months(self.study.anchors, horizons, self.study.months)
        summary = self.month_summary(segment, with_balance=False, months=months)
        forward = growth.forward_sums(summary, segment.name, horizons)
        return growth.anchor_averages(forward, segment.name, self.study.anchors, horizons)

    def latest_spend(self, segment: Segment) -> DataFrame:
        latest = self.study.latest
        summary = self.month_summary(
            segment, with_balance=False, months=MonthRange(latest, latest)
        )
        return growth.snapshot_at(summary, segment.name, latest)

    def growth_ratios(self, segment: Segment, spec: GrowthSpec) -> DataFrame:
        """Only the months that the index depends on are read."""
        months = spec.months_read(self.study.months)
        summary = self.month_summary(segment, with_balance=False, months=months)
        return growth.growth_ratios(summary, segment.name, spec)

    def growth_ranks(self, segment: Segment, spec: GrowthSpec) -> DataFrame:
        return growth.growth_ranks(self.growth_ratios(segment, spec), segment.name, spec)

    def index_components(self, segment: Segment, spec: GrowthSpec) -> DataFrame:
        return growth.index_components(self.growth_ranks(segment, spec), segment.name, spec)

    def growth_index(
        self, segment: Segment, spec: GrowthSpec, keep: Sequence[str] | None = None
    ) -> DataFrame:
        return growth.growth_index(self.growth_ratios(segment, spec), segment.name, spec, keep)

    def growth_index_state(self) -> DataFrame:
        return self.growth_index(
            STATE, self.study.growth(STATE_WEIGHTS), keep=self.study.keep_regions
        )

    def growth_index_state_industry(self) -> DataFrame:
        return self.growth_index(STATE_INDUSTRY, self.study.growth(STATE_INDUSTRY_WEIGHTS))
