"""Constants of a study: its months, its regions and its index weights."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from monthweave.operators.calendar import MonthRange
from monthweave.operators.growth import AnchorWeights, GrowthSpec
from monthweave.operators.panel import Segment
from monthweave.schemas import INDUSTRY, REGION

STATE = Segment(REGION, (REGION,))
STATE_INDUSTRY = Segment("state_industry", (REGION, INDUSTRY))

# Index weights (first anchor, second anchor) per segment kind.
STATE_WEIGHTS = (
    AnchorWeights(ratios=Decimal("0.4")),
    AnchorWeights(ratios=Decimal("0.8"), latest=Decimal("0.8")),
)
STATE_INDUSTRY_WEIGHTS = (
    AnchorWeights(ratios=Decimal("0.4")),
    AnchorWeights(ratios=Decimal("0.8"), latest=Decimal("1.2")),
)


@dataclass(frozen=True)
class Study:
    months: MonthRange
    leader_month: date
    share_region: str
    anchors: tuple[date, date]
    latest: date
    keep_regions: tuple[str, ...]

    def growth(self, weights: tuple[AnchorWeights, AnchorWeights]) -> GrowthSpec:
        by_anchor: Mapping[date, AnchorWeights] = dict(zip(self.anchors, weights, strict=True))
        return GrowthSpec(latest=self.latest, weights=by_anchor)


# Months and regions of the bank-account questions.
ACCOUNT_STUDY = Study(
    months=MonthRange(date(2019, 4, 1), date(2021, 1, 1)),
    leader_month=date(2019, 9, 1),
    share_region="CA",
    anchors=(date(2019, 9, 1), date(2020, 9, 1)),
    latest=date(2021, 1, 1),
    keep_regions=("UT", "MI", "CA", "WA", "MA", "TX", "TN", "NV", "IL", "NY"),
)

# The same shape over the order tables: whole date range, last month as latest,
# anchors 16 and 4 months before it.
RETAIL_STUDY = Study(
    months=MonthRange(date(1995, 1, 1), date(2001, 11, 1)),
    leader_month=date(2000, 7, 1),
    share_region="NATION_7",
    anchors=(date(2000, 7, 1), date(2001, 7, 1)),
    latest=date(2001, 11, 1),
    keep_regions=tuple(f"NATION_{k}" for k in (1, 3, 5, 7, 9, 11, 13, 17, 19, 23)),
)
