"""Exact ``rank()`` over groups of any size and with any number of ties, in one plan for all sizes.

A rank window over a whole group would send it to one task, and all equal values with it. Here
equal values become one row with their count first, so a frequent value is one row for each
task and no task holds the rows that have it. A value's rank is one more than the rows of
smaller values: those of earlier ranges (each group is cut into value ranges by a fixed scale, of
which one row each meets the others of its group) and those of smaller values within the own
range. The rows then look up the rank of their value in a join with a plain shuffle on both sides,
which adaptive execution splits where a value is frequent. Only keys and values are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges for each unit of the natural logarithm of one plus a value: neighbouring ranges
#: are a thousandth apart, so a group has some thousand ranges whatever its size.
RANGES_PER_LOG = 1024


@dataclass(frozen=True)
class Rank:
    """Rank ``output`` by the column ``value``, in which a null counts as ``missing``."""

    output: str
    value: str
    descending: bool = False
    missing: int = 0

    def compared(self) -> Column:
        return F.coalesce(F.col(self.value), F.lit(self.missing))


def value_range(value: Column) -> Column:
    """The number of a value's range; it never falls as the value grows."""
    size = F.floor(F.log1p(F.abs(value.cast("double"))) * RANGES_PER_LOG)
    return F.when(value < 0, -size - 1).otherwise(size)


def ranked_values(
    df: DataFrame,
    ranks: Sequence[Rank],
    key: Sequence[str],
    group: str | None = None,
    carried: Sequence[str] = (),
    once: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``df`` and each rank: ``key``, ``carried``, ``measure`` (the rank's place
    in ``ranks``), ``rank`` within ``group`` (the whole table if None; a null group is one too) and
    the columns ``once``, which are null but for the first rank.
    """
    columns = dict(df.select(*once, *[r.compared().alias(f"v{j}") for j, r in enumerate(ranks)]).dtypes)
    values = [f"v{j}" for j in range(len(ranks))]

    def measure(i: int, r: Rank) -> Column:
        # Known not to be null, or the joins below would each filter nulls in their own copy of the plan.
        low = F.coalesce(value_range(r.compared()), F.lit(0))
        # One column a rank, since their types differ; those of the others are zero.
        zero = lambda j: F.lit(0).cast(columns[f"v{j}"])
        own = [
            (F.coalesce(q.compared(), zero(j)) if i == j else zero(j)).alias(f"v{j}") for j, q in enumerate(ranks)
        ]
        first = [(F.lit(None) if i else F.col(c)).cast(columns[c]).alias(c) for c in once]
        return F.struct(F.lit(i).alias("measure"), (-low if r.descending else low).alias("range"), *own, *first)

    # A struct is never null, even of a null group.
    in_group = F.struct(F.col(group) if group else F.lit(0)).alias("_group")
    rows = df.select(
        in_group, *key, *carried, F.inline(F.array(*[measure(i, r) for i, r in enumerate(ranks)]))
    )
    own_range = W.partitionBy("_group", "measure", "range")
    order = [F.desc(v) if r.descending else F.asc(v) for v, r in zip(values, ranks)]
    smaller = own_range.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    distinct = (
        rows.groupBy("_group", "measure", "range", *values)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(smaller), F.lit(0)))
    )
    earlier = W.partitionBy("_group", "measure").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        distinct.groupBy("_group", "measure", "range")
        .agg(F.max(F.col("_before") + F.col("_rows")).alias("_in_range"))
        .select("_group", "measure", "range", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_start"))
    )
    placed = distinct.join(starts, ["_group", "measure", "range"]).select(
        "_group", "measure", *values, (F.col("_start") + F.col("_before") + 1).cast("bigint").alias("rank")
    )
    found = rows.drop("range").join(placed, ["_group", "measure", *values])
    return found.select(*key, *carried, "measure", "rank", *once)


def add_ranks(
    df: DataFrame, ranks: Sequence[Rank], key: Sequence[str], group: str | None = None
) -> DataFrame:
    """Add every rank within ``group`` (the whole table if None).

    ``key`` tells rows apart. Every row becomes one row a rank, all ranks are found in
    one pass, and the rows are put together again by their key.
    """
    rest = [c for c in df.columns if c not in key]
    found = ranked_values(df, ranks, key, group, once=rest)
    of_measure = lambda i: F.max(F.when(F.col("measure") == i, F.col("rank")))
    together = found.groupBy(*key).agg(
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in rest],
        *[of_measure(i).alias(r.output) for i, r in enumerate(ranks)],
    )
    return together.select(*df.columns, *[r.output for r in ranks])
