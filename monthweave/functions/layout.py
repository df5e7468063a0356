"""Where rows lie, for results known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.schemas import MONTH


def in_month_order(per_month: DataFrame) -> DataFrame:
    """Sort a table of one row per month.

    A calendar is short whatever the data, so its rows go to one task; a
    range-partitioned sort would run a sampling job first.
    """
    return per_month.repartition(1).orderBy(F.col(MONTH).asc_nulls_last())
