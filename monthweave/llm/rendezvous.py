"""Shards by rendezvous hashing of record keys, from DataFrame functions only.

Every shard draws a number for every key; the shard with the smallest draw, after
division by its weight, gets the record. A further shard can only win records for
itself, and a removed one only loses its own, so a changed shard count moves no other
record. No shuffle is needed to place a record; only the gapless numbering within
shards moves rows, cut into many pieces of each shard. Equal rows are counted before they
are numbered, so neither a frequent key nor a frequent row fills a piece.

Cases: a null key draws like any other value, so all null keys share a shard. Repeated
rows share a shard and get slots of their own. A null text has size 8 and the checksum
of the empty text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_BYTES = 8
PIECE_BITS = 10
#: Equal rows that are written out together.
RUN = 1 << 12


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """An exponential variate of rate ``weight`` that depends on key and shard alone."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """The winning shard with its draw, as a struct (draw, shard); ties take the smaller shard."""
    draws = [
        F.struct(draw(key, s, w).alias("draw"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights, first)
        if w > 0
    ]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return F.least(*draws) if len(draws) > 1 else draws[0]


def with_shards(
    df: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0
) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the place with one more shard at the end."""
    n = len(weights)
    best = rendezvous(F.col(key), weights)
    more = rendezvous(F.col(key), [grown_weight], first=n)
    return df.select(
        "*",
        best.getField("shard").alias("shard"),
        F.least(best, more).getField("shard").alias("grown_shard"),
    )


def with_slots(df: DataFrame, key: str, ties: Sequence[str] = (), bits: int = PIECE_BITS) -> DataFrame:
    """Number the rows of every ``shard`` from 0 without gaps.

    The order is that of a hash of key and ``ties``, then the key, ``ties`` and all else; it does
    not depend on the number of pieces. A piece is a range of the hash, ``2 ** bits`` of them a
    shard; one row for each piece is all that the running count sees. Rows that are equal
    in all columns are one row with a count until they have their slots.
    """
    columns = df.columns
    rest = [c for c in columns if c not in ("shard", key, *ties)]
    hashed = df.withColumn("_hash", F.xxhash64(key, *ties, F.lit("slot"))).withColumn(
        "_piece", F.shiftright("_hash", 64 - bits)
    )
    equal = hashed.groupBy(*columns, "_hash", "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    counts = equal.groupBy("shard", "_piece").agg(F.sum("_rows").alias("_rows"))
    before = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    inside = (
        W.partitionBy("shard", "_piece")
        .orderBy("_hash", key, *ties, *rest)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    placed = equal.withColumn("_place", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    runs = (
        placed.join(starts, ["shard", "_piece"])
        .withColumn("_low", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1, F.lit(RUN))))
        .repartition("_hash", "_low")
    )
    high = F.least(F.col("_low") + (RUN - 1), F.col("_rows") - 1)
    return runs.withColumn("_copy", F.explode(F.sequence("_low", high))).select(
        *columns, (F.col("_start") + F.col("_place") + F.col("_copy")).cast("long").alias("slot")
    )


def shard_texts(
    docs: DataFrame,
    weights: Sequence[float],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Columns doc_id, size (UTF-8 bytes plus 8), text_crc32, shard, grown_shard, slot."""
    octets = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(octets) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
    )
    return with_slots(with_shards(slim, "doc_id", weights), "doc_id", ("text_crc32", "size"))
