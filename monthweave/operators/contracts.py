"""Table contracts as jobs that return what breaks them.

Spark declares keys, nullability and lengths but does not enforce them on files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.schemas import TableContract


def duplicate_keys(df: DataFrame, key: Sequence[str], primary: bool = False) -> DataFrame:
    """Keys that occur more than once, with their row count.

    A primary key with a null is reported too. In a unique key a null clashes
    with nothing.
    """
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    rows = df if primary else df.where(~has_null)
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    broken = F.col("n_rows") > 1
    return counted.where(broken | has_null if primary else broken)


def null_counts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Nulls per required column, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in columns]
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline(pairs))


def off_calendar(df: DataFrame, table: str, month: str) -> DataFrame:
    """One row: how many rows are dated another day than the first of a month.

    No question over months counts them.
    """
    other = F.trunc(month, "month") != F.col(month)
    return df.agg(F.count_if(other).alias("off_calendar_rows"), F.count(F.lit(1)).alias("all_rows")).select(
        F.lit(table).alias("table_name"), "off_calendar_rows", "all_rows"
    )


def orphans(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of ``facts`` that ``dim`` does not have, with their row count; a null is none."""
    return (
        facts.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .join(dim.select(key).distinct(), key, "left_anti")
    )


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in a required column, with the names of those columns."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.withColumn("null_columns", missing).where(F.size("null_columns") > 0)


def limit_violations(
    df: DataFrame,
    key: Sequence[str],
    lengths: Mapping[str, int] | None = None,
    decimals: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """One row per value that is too long or outside its decimal type, by row key."""
    found = []
    for name, limit in (lengths or {}).items():
        found.append(_finding(name, f"varchar({limit})", F.length(F.col(name).cast("string")) > limit))
    for name, (precision, scale) in (decimals or {}).items():
        as_declared = F.col(name).try_cast(f"decimal({precision},{scale})")
        too_big = F.col(name).isNotNull() & as_declared.isNull()
        found.append(_finding(name, f"numeric({precision},{scale})", too_big))
    return df.select(*key, F.inline(F.array_compact(F.array(*found))))


def _finding(name: str, declared: str, broken) -> F.Column:
    return F.when(
        broken,
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(declared).alias("declared"),
            F.col(name).cast("string").alias("value"),
        ),
    )


def contract_report(df: DataFrame, contract: TableContract) -> DataFrame:
    """Number of violations per rule of ``contract``; zero everywhere on a clean table."""
    parts = [
        null_counts(df, contract.name, contract.required).select(
            "table_name",
            F.concat(F.lit("not null "), "column_name").alias("rule"),
            F.col("null_rows").alias("violations"),
        )
    ]
    if contract.key:
        kind = "primary key " if contract.primary else "unique "
        parts.append(
            duplicate_keys(df, contract.key, contract.primary)
            .agg(F.count(F.lit(1)).alias("violations"))
            .select(
                F.lit(contract.name).alias("table_name"),
                F.lit(kind + ", ".join(contract.key)).alias("rule"),
                "violations",
            )
        )
    if contract.lengths or contract.decimals:
        parts.append(
            limit_violations(df, contract.key, contract.lengths, contract.decimals)
            .agg(F.count(F.lit(1)).alias("violations"))
            .select(
                F.lit(contract.name).alias("table_name"),
                F.lit("declared lengths and ranges").alias("rule"),
                "violations",
            )
        )
    return reduce(DataFrame.unionByName, parts)
