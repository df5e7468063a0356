"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest, so that a batch meets it in
a sort-merge join that reads the index without a shuffle. A batch is first reduced to
one row per digest, then anti-joined with the index; what is left is appended.

Cases: a null text counts as empty. Texts are equal when identical without the
characters 0x20 and 0x09 to 0x0D. Repeated rows, ids included, are copies of which one
row stays. A null id loses against any other id of an equally long text. An empty table
appends nothing and gives no verdicts. Other columns are ignored. A very long text is one row of
which only the digest is shuffled. A batch that was cut short is repeated under its own
name: it finds what it appended, appends the rest, and gets the verdicts it would have had.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, cut, discard, with_row, without_rows

DELETED = " \t\n\x0b\x0c\r"
SCHEMA = "digest binary, keep_id long, keep_row long, batch string"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, in UTF-8."""
    bare = F.translate(F.coalesce(text, F.lit("")), DELETED, "")
    return F.unhex(F.sha2(bare.cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """An index in ``path``, open in ``spark`` as the table ``table``.

    Opening the same path again, in this session or a later one, finds what earlier
    batches appended; ``buckets`` must then be as before.
    """

    spark: SparkSession
    path: str
    buckets: int
    table: str

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int = 64) -> DigestIndex:
        table = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return DigestIndex(spark, path, buckets, table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Remove the index with its files, if no other batch will come; verdicts given before can still be read."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self.path)

    def append(self, rows: DataFrame) -> None:
        """Add rows whose digests the index does not hold; one file a bucket."""
        rows.repartition(self.buckets, "digest").select(
            "digest", "keep_id", "keep_row", "batch"
        ).write.insertInto(self.table)

    def deduplicate(
        self,
        docs: DataFrame,
        id_column: str = "doc_id",
        text_column: str = "text",
        batch: str | None = None,
    ) -> DataFrame:
        """Append the new texts of ``docs``; a verdict for each of its rows.

        Of equal texts in the batch the one with the most code points stays, then the
        smallest id; a text that another batch brought before keeps its earlier row, and
        none of this batch stays. ``group_size`` counts the rows of the batch. ``batch`` names the
        batch, so that it can be repeated; without a name it is a new one each time.
        Columns: _row (place in the batch), id, keep_id, group_size, kept, digest.
        """
        batch = batch or uuid.uuid4().hex
        text = F.col(text_column)
        base = cut(
            with_row(docs).select(
                ROW,
                F.col(id_column).alias("id"),
                text_digest(text).alias("digest"),
                F.coalesce(F.length(text), F.lit(0)).alias("points"),
            )
        )
        order = F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col(ROW))
        groups = base.groupBy("digest").agg(
            F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti").select(
            "digest",
            F.col("best.id").alias("keep_id"),
            F.col(f"best.{ROW}").alias("keep_row"),
            F.lit(batch).alias("batch"),
        )
        self.append(fresh)
        # Written, so that the join below has a plain shuffle on both sides and a frequent digest is split.
        held = cut(
            groups.join(self.rows().hint("merge"), "digest").select(
                "digest",
                "group_size",
                "keep_id",
                F.when(F.col("batch") == batch, F.col(f"best.{ROW}")).alias("keep_row"),
            )
        )
        return base.join(held, "digest").select(
            ROW,
            "id",
            "keep_id",
            "group_size",
            F.col(ROW).eqNullSafe(F.col("keep_row")).alias("kept"),
            "digest",
        )

    def kept_rows(
        self,
        docs: DataFrame,
        id_column: str = "doc_id",
        text_column: str = "text",
        batch: str | None = None,
    ) -> DataFrame:
        """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns."""
        dropped = self.deduplicate(docs, id_column, text_column, batch).filter(~F.col("kept"))
        return without_rows(docs, dropped)
