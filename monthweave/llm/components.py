"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no neighbourhood is ever gathered in one
row or task: the minimum is combined before the shuffle, and adaptive execution splits
the join of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.llm.storage import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("m").alias("u"), "v")
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of those neighbours."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(
        F.col("m"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("w")
    )
    own = least.select("m", F.col("v").alias("w"))
    return (
        moved.unionByName(own).filter("m <> w").select(F.col("m").alias("u"), F.col("w").alias("v"))
    ).distinct()


def _state(edges: DataFrame) -> tuple:
    """Size and order-free checksum of an edge set."""
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark % 1000003)).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component: the smallest node it is linked with, itself included.

    Nodes without a link to another node are left out. Repeated links, links both
    ways and links of a node with itself are fine; those with a null are dropped.
    """
    edges = cut(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v")))
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        after = _state(edges)
        # The number of steps grows with the links; their shuffle files must not.
        release(links.sparkSession)
        if after == before:
            break
        before = after
    members = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return members.unionByName(roots)
