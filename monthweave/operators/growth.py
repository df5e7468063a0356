"""Forward sums, growth ratios at anchor months, their ranks and the weighted index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthweave.functions.columns import month_number, months_later, ratio
from monthweave.operators.calendar import MonthRange, MonthRanges
from monthweave.operators.ranking import Rank, add_ranks, ranked_values
from monthweave.schemas import MONTH


@dataclass(frozen=True)
class AnchorWeights:
    """Weight of the ratio ranks and of the latest-spend rank at one anchor month."""

    ratios: Decimal
    latest: Decimal = Decimal("0.0")


@dataclass(frozen=True)
class GrowthSpec:
    """Settings of a growth index.

    ``weights`` names the anchor months. ``missing`` stands in for an unknown
    value when ranking; with amounts that are not negative it lies below all real ones. A higher rank means more growth.
    """

    latest: date
    weights: Mapping[date, AnchorWeights]
    horizons: tuple[int, ...] = (2, 4)
    missing: int = -99

    @property
    def anchors(self) -> tuple[date, ...]:
        return tuple(self.weights)

    def months_read(self, calendar: MonthRange) -> MonthRanges:
        """The months of ``calendar`` that the index depends on.

        These are the anchors, the months their forward sums reach, and the latest
        month. Following months stay next to their anchor, so the sums over the
        next rows are those of the full calendar.
        """
        return anchor_months(self.anchors, self.horizons, calendar, (self.latest,))


def anchor_months(
    anchors: Sequence[date],
    horizons: Sequence[int],
    calendar: MonthRange,
    others: Sequence[date] = (),
) -> MonthRanges:
    """Anchors with the months up to their furthest horizon, and ``others``, within ``calendar``."""
    reach = [(a, months_later(a, max(horizons))) for a in anchors] + [(o, o) for o in others]
    return MonthRanges.merged(
        MonthRange(first, min(last, calendar.last))
        for first, last in reach
        if calendar.first <= first <= calendar.last
    )


def forward_sums(
    summary: DataFrame, segment: str, horizons: Sequence[int] = (2, 4), gaps: bool = False
) -> DataFrame:
    """Spend and customers of the next h months, this month excluded; null where none of them is there.

    Rows are counted, so the summary must hold every month of every segment. With ``gaps`` months
    are compared by their number instead, and a month that is missing adds nothing.
    """
    in_order = W.partitionBy(segment)
    if gaps:
        ahead = in_order.orderBy(month_number(MONTH))
        frame = lambda h: ahead.rangeBetween(1, h)
    else:
        ahead = in_order.orderBy(F.col(MONTH).asc_nulls_last())
        frame = lambda h: ahead.rowsBetween(1, h)
    return summary.withColumns(
        {
            f"fwd{h}_{what}": F.sum(what).over(frame(h))
            for h in horizons
            for what in ("spend", "customers")
        }
    )


def with_latest_spend(summary: DataFrame, segment: str, latest: date) -> DataFrame:
    """Add the segment's spend in month ``latest`` to each of its rows.

    A window over the segment does it, sharing the shuffle of ``forward_sums``; a
    self-join would compute the summary twice.
    """
    seen = F.when(F.col(MONTH) == F.lit(latest), F.col("spend"))
    return summary.withColumn("latest_spend", F.max(seen).over(W.partitionBy(segment)))


def anchor_averages(
    forward: DataFrame, segment: str, anchors: Sequence[date], horizons: Sequence[int] = (2, 4)
) -> DataFrame:
    """Spend per customer at the anchor months and over the months that follow them."""
    carried = [c for c in ("latest_spend",) if c in forward.columns]
    return forward.where(F.col(MONTH).isin(list(anchors))).select(
        segment,
        MONTH,
        "spend",
        *carried,
        ratio(F.col("spend"), F.col("customers")).alias("avg_spend"),
        *[
            ratio(F.col(f"fwd{h}_spend"), F.col(f"fwd{h}_customers")).alias(f"avg_fwd{h}_spend")
            for h in horizons
        ],
    )


def snapshot_at(summary: DataFrame, segment: str, month: date) -> DataFrame:
    """Spend of every segment in one month."""
    return summary.where(F.col(MONTH) == F.lit(month)).select(
        segment, F.col("spend").alias("latest_spend")
    )


def growth_ratios(summary: DataFrame, segment: str, spec: GrowthSpec) -> DataFrame:
    """Forward average over anchor average per horizon, null where the anchor is zero."""
    forward = with_latest_spend(
        forward_sums(summary, segment, spec.horizons), segment, spec.latest
    )
    averages = anchor_averages(forward, segment, spec.anchors, spec.horizons)
    return averages.select(
        segment,
        MONTH,
        "latest_spend",
        *[
            ratio(F.col(f"avg_fwd{h}_spend"), F.col("avg_spend")).alias(f"ratio{h}")
            for h in spec.horizons
        ],
    )


def _measures(spec: GrowthSpec) -> list[Rank]:
    measures = ["latest_spend", *[f"ratio{h}" for h in spec.horizons]]
    return [Rank(f"rank_{m}", m, missing=spec.missing) for m in measures]


def growth_ranks(ratios: DataFrame, segment: str, spec: GrowthSpec) -> DataFrame:
    """Ascending ranks of latest spend and of each ratio among all segments of an anchor."""
    ranks = _measures(spec)
    ranked = add_ranks(ratios, ranks, key=(segment, MONTH), group=MONTH)
    return ranked.select(segment, MONTH, *[r.value for r in ranks], *[r.output for r in ranks])


def index_components(ranks: DataFrame, segment: str, spec: GrowthSpec) -> DataFrame:
    """Weighted rank sum per segment and anchor; exact decimals, zero at other months."""
    ratio_ranks = sum((F.col(f"rank_ratio{h}") for h in spec.horizons), F.lit(0).cast("bigint"))
    index = F.lit(Decimal("0.0"))
    for anchor, w in reversed(list(spec.weights.items())):
        score = F.lit(w.ratios) * ratio_ranks + F.lit(w.latest) * F.col("rank_latest_spend")
        index = F.when(F.col(MONTH) == F.lit(anchor), score).otherwise(index)
    return ranks.select(segment, MONTH, "latest_spend", index.alias("growth_index"))


def final_index(
    components: DataFrame, segment: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """Index summed over the anchors, best first.

    ``keep`` limits the report, not the competition: ranks already count every
    segment.
    """
    if keep is not None:
        components = components.where(F.col(segment).isin(list(keep)))
    return (
        components.groupBy(segment, "latest_spend")
        .agg(F.sum("growth_index").alias("overall_growth_index"))
        .orderBy(F.col("overall_growth_index").desc_nulls_last(), F.col(segment))
    )


def growth_index(
    ratios: DataFrame, segment: str, spec: GrowthSpec, keep: Sequence[str] | None = None
) -> DataFrame:
    """What ``final_index`` makes of the components, without putting the ranks of a row together first.

    The index is a sum of weighted ranks, so each rank goes to its segment directly. Segments are
    kept by a sum's outcome: a filter on their names would move down to the tables on one side of
    the ranks, and these would be read twice.
    """
    ranks = _measures(spec)
    found = ranked_values(ratios, ranks, (segment, MONTH), group=MONTH, carried=("latest_spend",))
    weight = F.lit(Decimal("0.0"))
    for anchor, w in spec.weights.items():
        of_measure = F.when(F.col("measure") == 0, F.lit(w.latest)).otherwise(F.lit(w.ratios))
        weight = F.when(F.col(MONTH) == F.lit(anchor), of_measure).otherwise(weight)
    kept = F.lit(True) if keep is None else F.col(segment).isin(list(keep))
    return (
        found.groupBy(segment, "latest_spend")
        .agg(F.sum(weight * F.col("rank")).alias("overall_growth_index"), F.bool_or(kept).alias("_kept"))
        .where("_kept")
        .drop("_kept")
        .orderBy(F.col("overall_growth_index").desc_nulls_last(), F.col(segment))
    )
