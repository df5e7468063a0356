"""Unique keys of tables that grow by batches.

The keys of all batches so far lie in a bucketed, sorted index, one partition for each batch. A batch
is reduced to one row for each key, stored, and met with the others' keys bucket by bucket:
neither side of that join is shuffled, however many batches there were.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthweave.sources.tables import Buckets, read_buckets, replace_partition

BATCH, ROWS = "batch", "n_rows"


@dataclass(frozen=True)
class KeyIndex:
    """An index in ``path`` of the columns of ``key``; opened again, it holds what was added before.

    ``buckets`` and ``key`` must then be the same.
    """

    spark: SparkSession
    path: str
    key: T.StructType
    buckets: int = 64

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.key.fields]

    def _dealt(self) -> Buckets:
        return Buckets(tuple(self.names), self.buckets)

    def rows(self) -> DataFrame:
        """Columns of the key, n_rows and batch."""
        schema = T.StructType(
            [*self.key.fields, T.StructField(ROWS, T.LongType()), T.StructField(BATCH, T.StringType())]
        )
        return read_buckets(self.spark, schema, self.path, self._dealt(), partition_by=BATCH)

    def add(self, df: DataFrame, batch: str) -> DataFrame:
        """Add the keys of ``df`` and return those that break uniqueness: with n_rows in this batch
        and n_before in the other batches, of which there is one row at least.

        A key with a null clashes with nothing and is not kept. The same ``batch`` again
        takes the place of its former self, so an add that was cut short can be repeated.
        """
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.names])
        counted = df.where(known).groupBy(*self.names).agg(F.count(F.lit(1)).alias(ROWS))
        replace_partition(counted, self.path, BATCH, batch, self._dealt())
        return self.clashes(batch)

    def clashes(self, batch: str) -> DataFrame:
        """What ``add`` returned for a batch, or would return now that others were added."""
        index = self.rows()
        own = index.where(F.col(BATCH) == batch).drop(BATCH)
        others = index.where(F.col(BATCH) != batch).groupBy(*self.names).agg(F.sum(ROWS).alias("n_before"))
        met = own.join(others, self.names, "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
        return met.where((F.col(ROWS) > 1) | (F.col("n_before") > 0))
