"""Read and write the declared tables with their declared schemas; nothing is inferred."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from monthweave.schemas import MONTH, TableContract


@dataclass(frozen=True)
class Buckets:
    """Rows of a stored table are dealt into ``number`` buckets by ``key`` and sorted by it.

    Tables with equal numbers of buckets are joined on their keys, and grouped by them, without a
    shuffle. A bucket is read by one task, so a key that holds a large part of all rows is better
    left to a plain table, whose joins adaptive execution can split.
    """

    key: tuple[str, ...]
    number: int = 64


def read_table(
    spark: SparkSession,
    table: TableContract,
    path: str,
    fmt: str = "parquet",
    buckets: Buckets | None = None,
    **options: str,
) -> DataFrame:
    """Scan ``table`` from files of format ``fmt`` (parquet, orc, csv, json).

    ``buckets`` must be those that the files were appended with.
    """
    if buckets is not None:
        return read_buckets(spark, table.schema, path, buckets, fmt=fmt)
    if fmt == "csv":
        options = {"header": "true", **options}
    if fmt in ("csv", "json"):
        # A broken row fails the job; it would come back as nulls otherwise.
        options = {"mode": "FAILFAST", **options}
    return spark.read.format(fmt).schema(table.schema).options(**options).load(path)


def rows_of(spark: SparkSession, table: TableContract, rows: Iterable[tuple]) -> DataFrame:
    """A small hand-written row list as a table; a null in a required column fails."""
    return spark.createDataFrame(list(rows), table.schema)


def append_rows(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: str | None = None,
    buckets: Buckets | None = None,
    **options: str,
) -> None:
    """Append to a stored table.

    Facts partitioned by their month let one-month questions read one month. Rows
    then go to one writer per month and slice, which keeps the files few and a
    large month spread over several. With ``buckets`` each bucket gets one sorted file
    from each append (and of each value of ``partition_by``).
    """
    if buckets is not None:
        name = _stored(df.sparkSession, df.schema, path, buckets, partition_by, fmt)
        rows = df.repartition(buckets.number, *buckets.key).select(df.sparkSession.table(name).columns)
        rows.write.insertInto(name)
        return
    writer = df.write.mode("append").format(fmt).options(**options)
    if partition_by is not None:
        writer = df.hint("rebalance", partition_by).write.mode("append").format(fmt)
        writer = writer.options(**options).partitionBy(partition_by)
    writer.save(path)


def replace_partition(df: DataFrame, path: str, partition_by: str, value: str, buckets: Buckets) -> None:
    """Store rows of a table partitioned by a text in place of those stored for ``value`` before."""
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField(partition_by, StringType())])
    name = _stored(spark, schema, path, buckets, partition_by, "parquet")
    quoted = value.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
    columns = ", ".join(f"`{c}`" for c in spark.table(name).columns if c != partition_by)
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION (`{partition_by}` = '{quoted}') SELECT {columns} FROM {{rows}}",
        rows=df.repartition(buckets.number, *buckets.key),
    )


def read_buckets(
    spark: SparkSession,
    schema: StructType,
    path: str,
    buckets: Buckets,
    partition_by: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Rows of a table that ``append_rows`` or ``replace_partition`` stored with these buckets."""
    name = _stored(spark, schema, path, buckets, partition_by, fmt)
    spark.catalog.refreshTable(name)
    return spark.table(name).select([f.name for f in schema.fields])


def _stored(
    spark: SparkSession, schema: StructType, path: str, buckets: Buckets, partition_by: str | None, fmt: str
) -> str:
    """The session's name of the table in ``path``; files that are there already belong to it."""
    name = f"monthweave_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    key = ", ".join(f"`{k}`" for k in buckets.key)
    parts = f"PARTITIONED BY (`{partition_by}`)" if partition_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt} {parts} "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets.number} BUCKETS LOCATION '{path}'"
    )
    return name


#: Formats that Spark reads by its first kind of source, which does not answer from footers.
FIRST_KIND = "spark.sql.sources.useV1SourceList"


def stored_month_bounds(spark: SparkSession, table_path: str, month: str = MONTH) -> DataFrame:
    """One row: first and last month of a stored Parquet table.

    Where ``spark.sql.parquet.aggregatePushdown`` is on, as ``build_session`` sets it, the bounds of a
    DATE column come from the footers of the files and no row is read. Other types,
    and sessions without it, scan the column.
    """
    before = spark.conf.get(FIRST_KIND)
    spark.conf.set(FIRST_KIND, ",".join(f for f in before.split(",") if f != "parquet"))
    try:
        found = spark.read.parquet(table_path)  # the kind of source is settled here
    finally:
        spark.conf.set(FIRST_KIND, before)
    return found.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
