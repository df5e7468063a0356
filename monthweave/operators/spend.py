"""Spend rows and the way from them to their organization."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.schemas import MONTH, ORG_ID, SPEND


@dataclass(frozen=True)
class Spend:
    """Rows whose amounts add up to the spend of each (organization, month).

    Either every row names its organization, or ``link`` leads to it through
    ``owners`` (one row per link). Where the rows outnumber the owners, columns of
    the organization go to the owners first and the rows are shuffled once, on the
    link. Where only a few rows are read, ``owners_first=False`` finds their
    organization first, and no wide row per owner is shuffled.
    """

    rows: DataFrame
    owners: DataFrame | None = None
    link: str | None = None
    owners_first: bool = True

    def by_org(self) -> DataFrame:
        """Rows with their organization; null where no owner is known."""
        rows = self.rows
        if self.owners is not None:
            rows = rows.join(self.owners, self.link, "left")
        return rows.select(ORG_ID, MONTH, SPEND)

    def joined_to(self, members: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with the columns of ``members``, a table with one row per organization."""
        if self.owners is None:
            return self.rows.join(members, ORG_ID, how)
        if self.owners_first:
            return self.rows.join(self.owners.join(members, ORG_ID, how), self.link, how)
        return self.rows.join(self.owners, self.link, how).join(members, ORG_ID, how)

    def table(self) -> DataFrame:
        """One row per (organization, month)."""
        return self.by_org().groupBy(ORG_ID, MONTH).agg(F.sum(SPEND).alias(SPEND))
