"""Near-duplicate classes of texts by MinHash.

1. Every text becomes its set of word shingles, and the set 128 universal hash minima.
   Equal sets are one node from here on, whatever the number of their copies.
2. Bands of four minima put nodes into buckets. At a Jaccard similarity of 0.75 two
   nodes miss each other in all 32 bands once in 190,000 pairs.
3. Every node is compared with one hub, the node among all of its buckets that meets the most others:
   first the signatures, then, where these agree well enough, the full sets. That is one pair a node
   and joins nearly all that belongs together, a large group of copies around its origin included.
4. Buckets whose nodes are now in one component are done. In the others all nodes of different
   components are compared, on full sets, within the tasks: a matrix product counts the common
   shingles of a block of nodes, and only the links of a spanning forest come out. A large bucket
   is cut into blocks that meet in pairs, those of its main component only with the others, so no
   task gets more than two blocks. Buckets of the same nodes are compared once.
5. Components are grown by large-star and small-star steps.

Shuffle files are let go after each step, so the disk holds those of one step beside what is written.

Cases: a null text, an empty one and one without words has no set, size 0, and is alone in
its class. A text of fewer than five words has its whole sequence as its one shingle. Repeated
rows are nodes of one class. A class of which all ids are null has a null component;
its rows are kept like any row whose id is its component's. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from monthweave.llm.components import connected_components
from monthweave.llm.storage import ROW, cut, discard_kept, keep, release, with_row
from monthweave.llm.words import U64, mixed, shingle_sets, small_batches

MINIMA = 128
BAND_ROWS = 4
BANDS = MINIMA // BAND_ROWS
THRESHOLD = 0.75
#: Signatures that agree in less than this share are not compared in full: at a true
#: similarity of 0.75 that is over five standard deviations away.
SIGNATURE_SHARE = 0.55
#: Nodes and shingles of a block.
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 20
#: Columns of the matrix whose product is taken at once.
COLUMNS = 2048
#: Shingles hashed at a time; bounds the working arrays.
PIECE = 1 << 15

_random = np.random.Generator(np.random.PCG64(77))
_FACTOR = _random.integers(0, 2**63, MINIMA, dtype=U64) * U64(2) + U64(1)
_SHIFT = _random.integers(0, 2**63, MINIMA, dtype=U64) * U64(2)
_MIX = _random.integers(0, 2**63, (BANDS, BAND_ROWS), dtype=U64) * U64(2) + U64(1)
_BAND = _random.integers(0, 2**63, BANDS, dtype=U64)


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each non-empty set, the least value under each of the universal hashes."""
    sizes = np.diff(starts)
    out = np.empty((len(sizes), MINIMA), U64)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + PIECE, "right")) - 1)
        part = shingles[starts[low] : starts[high]]
        at = starts[low:high] - starts[low]
        work = np.empty_like(part)
        for k in range(MINIMA):
            np.multiply(part, _FACTOR[k], out=work)
            work += _SHIFT[k]
            out[low:high, k] = np.minimum.reduceat(work, at)
        low = high
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket key for each row and band."""
    grouped = values.reshape(len(values), BANDS, BAND_ROWS)
    return mixed((mixed(grouped) * _MIX).sum(2, dtype=U64) + _BAND)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        text = batch.column("text")
        sets = list(shingle_sets(text))
        sizes = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(sizes)
        keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        marks: list = [None] * len(sets)
        bands: list = [None] * len(sets)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(sizes[some])])
            values = minima(np.concatenate([sets[i] for i in some]), starts)
            short = (values >> U64(48)).astype(np.uint16)
            buckets = band_keys(values).view(np.int64)
            for i, mark, band in zip(some, short, buckets):
                marks[i], bands[i] = mark.tobytes(), band
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(ROW),
                batch.column("id"),
                pa.array(sizes),
                pa.array(keys, pa.binary()),
                pa.array(marks, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            [ROW, "id", "n_shingles", "key", "mark", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
        )


@F.pandas_udf(IntegerType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Minima in which two signatures agree."""
    left = np.frombuffer(b"".join(a), np.uint16).reshape(-1, MINIMA)
    right = np.frombuffer(b"".join(b), np.uint16).reshape(-1, MINIMA)
    return pd.Series((left == right).sum(1, dtype=np.int32))


def _side(of: DataFrame, at: str, value: str) -> DataFrame:
    return of.select(F.col("node").alias(at), F.col(value).alias(f"{value}_{at}"))


def _confirmed(pairs: DataFrame, marks: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree and whose full sets then reach the threshold."""
    near = (
        pairs.join(_side(marks, "a", "mark"), "a")
        .join(_side(marks, "b", "mark"), "b")
        .filter(agreeing("mark_a", "mark_b") >= int(SIGNATURE_SHARE * MINIMA))
        .select("a", "b")
    )
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - shared
    return (
        cut(near)
        .join(_side(sets, "a", "shingles"), "a")
        .join(_side(sets, "b", "shingles"), "b")
        .filter(shared * 100 >= union * _percent(threshold))
        .select("a", "b")
    )


def _percent(threshold: float) -> int:
    return int(round(threshold * 100))


def hub_pairs(members: DataFrame) -> DataFrame:
    """For every node the pair with the most met node of its buckets, if that is another one."""
    met = members.groupBy("node").agg(F.sum("met").alias("degree"))
    ranked = members.join(met, "node").select("bucket", "node", F.struct("degree", "node").alias("rank"))
    heads = ranked.groupBy("bucket").agg(F.max("rank").alias("head"))
    best = (
        members.select("bucket", "node")
        .join(heads, "bucket")
        .groupBy("node")
        .agg(F.max("head").getField("node").alias("hub"))
        .filter("node <> hub")
    )
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def open_cells(members: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """Where nodes of different components still have to meet: columns cell, node, component, part.

    A cell is a block of a bucket (part 0 only) or two blocks of it (parts 0 and 1).
    """
    named = cut(
        members.join(labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
    )
    mark = F.xxhash64("node")
    buckets = named.groupBy("bucket").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.count(F.lit(1)).alias("nodes"),
        F.bit_xor(mark).alias("mark"),
        F.sum(mark % 1000003).alias("mark_sum"),
        F.min("node").alias("a"),
        F.max("node").alias("b"),
        F.sum("size").alias("shingles"),
        F.max(F.struct("degree", "component")).getField("component").alias("main"),
    )
    different = (
        buckets.filter("lo < hi")
        .groupBy("nodes", "mark", "mark_sum", "a", "b")
        .agg(
            F.min("bucket").alias("bucket"),
            F.first("shingles").alias("shingles"),
            F.first("main").alias("main"),
        )
    )
    two = different.filter("nodes = 2").join(tested, ["a", "b"], "left_anti")
    open_buckets = (
        different.filter("nodes > 2")
        .unionByName(two)
        .select(
            "bucket",
            "main",
            F.greatest(
                F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
            ).alias("blocks"),
        )
    )
    # In a bucket of several blocks those of the main component come first and do not
    # meet each other.
    placed = cut(
        named.join(open_buckets, "bucket").select(
            "bucket",
            "node",
            "component",
            "blocks",
            ((F.col("component") == F.col("main")) & (F.col("blocks") > 1)).alias("is_main"),
            F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).alias("block"),
        )
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    mixed_cells = placed.select("*", other).filter("blocks > 1")
    across = mixed_cells.select(
        "bucket",
        F.lit(1).alias("kind"),
        F.when(F.col("is_main"), F.col("block")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("is_main"), F.col("other")).otherwise(F.col("block")).alias("j"),
        "node",
        "component",
        F.when(F.col("is_main"), 0).otherwise(1).alias("part"),
    )
    among = placed.filter("blocks = 1").select("*", F.col("block").alias("other")).unionByName(
        mixed_cells.filter(~F.col("is_main"))
    ).select(
        "bucket",
        F.lit(0).alias("kind"),
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "node",
        "component",
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("part"),
    )
    return across.unionByName(among).select(
        F.struct("bucket", "kind", "i", "j").alias("cell"), "node", "component", "part"
    )


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets reach the threshold with which, as a square of booleans."""
    sizes = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    use = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, width - low)), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        common += block @ block.T
    np.fill_diagonal(common, sizes)
    union = sizes[:, None] + sizes[None, :] - common
    return common * 100 >= union * _percent(threshold)


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a forest that joins all that is linked."""
    todo = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(linked[x] & todo)
            todo[near] = False
            out += [(x, int(y)) for y in near]
            queue += near.tolist()
    return out


def _compare(threshold: float) -> Callable:
    """Links within each cell; the rows of a cell come one after the other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, components, parts, sets = None, [], [], [], []

        def links() -> pa.RecordBatch:
            part, component = np.array(parts), np.array(components)
            linked = linked_pairs(sets, threshold)
            # Links within a component are known already, except as far as the forest needs them.
            linked &= component[:, None] != component[None, :]
            if part.any():
                linked &= part[:, None] != part[None, :]
            found = spanning_links(linked)
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())],
                ["a", "b"],
            )

        for batch in batches:
            flat = batch.column("shingles").flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(batch.column("shingles").value_lengths().to_numpy())])
            rows = zip(*(batch.column(n).to_pylist() for n in ("cell", "node", "component", "part")))
            for k, (mine, node, component, part) in enumerate(rows):
                if mine != cell and nodes:
                    yield links()
                    nodes, components, parts, sets = [], [], [], []
                cell = mine
                nodes.append(node)
                components.append(component)
                parts.append(part)
                sets.append(flat[at[k] : at[k + 1]])
        if nodes:
            yield links()

    return compare


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Columns _row (place in ``docs``), id, n_shingles, component_id, stays, kept.

    ``kept`` marks rows whose id is their component's, ``stays`` exactly one row of each
    component; they differ where ids are null or repeated.
    """
    spark = docs.sparkSession
    texts = with_row(docs).select(
        ROW, F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    base = keep(
        texts.mapInArrow(
            _describe,
            f"{ROW} long, id long, n_shingles long, key binary, mark binary, bands array<long>",
        ),
        "minima",
    )
    heads = base.filter("key is not null").groupBy("key").agg(F.min(ROW).alias(ROW))
    nodes = base.join(heads.select(ROW), ROW, "left_semi").withColumnRenamed(ROW, "node")
    entries = nodes.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    members = keep(entries.join(shared, "bucket"), "buckets")
    release(spark)
    met = cut(members.select("node").distinct())
    sets = keep(
        texts.select(F.col(ROW).alias("node"), "text")
        .join(met, "node", "left_semi")
        .mapInArrow(_sets, "node long, shingles array<long>"),
        "sets",
    )
    release(spark)
    tested = cut(hub_pairs(members))
    release(spark)
    links = cut(_confirmed(tested, nodes.select("node", "mark"), sets, threshold))
    release(spark)
    labels = cut(connected_components(links))
    degrees = members.groupBy("node").agg(F.sum("met").alias("degree"))
    cells = open_cells(members.join(degrees, "node"), labels, tested)
    more = cut(
        cells.join(sets, "node")
        .select(F.xxhash64("cell").alias("cell"), "node", "component", "part", "shingles")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_compare(threshold), "a long, b long")
    )
    discard_kept(members, sets)
    release(spark)
    if not more.isEmpty():
        labels = cut(connected_components(links.unionByName(more)))
        release(spark)
    return _classes(base, heads, labels)


def _classes(base: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Give every row the smallest id of its component and mark one row of it."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col(ROW))
    ids = base.filter("key is not null").groupBy("key").agg(F.min(first).alias("least"))
    named = (
        heads.join(ids, "key")
        .join(labels.withColumnRenamed("node", ROW), ROW, "left")
        .select("key", "least", F.coalesce("component", ROW).alias("component"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("best"))
    by_key = named.join(least, "component").select("key", "best")
    alone = F.col("key").isNull()
    return (
        base.select(ROW, "id", "n_shingles", "key")
        .join(by_key, "key", "left")
        .select(
            ROW,
            "id",
            "n_shingles",
            F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
            (alone | (F.col(ROW) == F.col(f"best.{ROW}"))).alias("stays"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
