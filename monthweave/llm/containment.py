"""Short items inside long documents: MinHash containment search, then exact counts.

Documents are partitioned by size: one of n shingles is sketched with between 2n and 4n
bins of the hash range, each holding its least hash (one-permutation MinHash). So a shingle
of a document is one of its minima with a chance of at least 0.78, whatever the
length, where a signature of fixed length would lose short items in long documents. An
item's shingle is a minimum from some number of bins on, and stays one in any finer
sketch, so one entry a shingle, with that number, serves all partitions. Items that need
few shared shingles are matched against all shingles instead.

A bitmap of fixed size over the items' shingles drops nearly all foreign minima where the document is
read; documents that keep one go on with their text. They meet the items in a
shuffle join, and pairs with enough common minima are verified on the words themselves.

Cases: null and empty texts and texts without words hold nothing and are found in nothing. An
item of fewer than five words is its whole word sequence, found only in a text that consists
of that sequence. Repeated rows on either side are each reported. Null ids are carried along. An
empty table on either side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, cut, keep, with_row
from monthweave.llm.words import SHINGLE_WORDS, U64, shingle_sets, small_batches

THRESHOLD = 0.75
#: Items that need fewer shared shingles than this skip the sketch of the documents.
ALL_BELOW = 16
#: Share of the needed shingles that must meet in the sketches; a quarter is more than five
#: standard deviations below what a contained item shows.
SKETCH_SHARE = 0.25
BITMAP_BITS = 1 << 23
CHUNK_BITS = 1 << 15

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def needed(n_shingles: int, threshold: float) -> int:
    return math.ceil(threshold * n_shingles - 1e-9)


def size_class(n: int) -> int:
    """Log2 of the number of bins for a set of n shingles: 2n up to 4n."""
    return max(1, int(n).bit_length() + 1)


def is_minimum(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the sorted hashes are the least of their bin, with 2 ** bits bins."""
    bins = hashes >> U64(64 - bits)
    first = np.ones(len(hashes), bool)
    first[1:] = bins[1:] != bins[:-1]
    return first


def least_bits(hashes: np.ndarray) -> np.ndarray:
    """From how many bits on each of the sorted hashes is a minimum: one more than it
    shares with its predecessor."""
    out = np.ones(len(hashes), np.int32)
    for k, common in enumerate((hashes[1:] ^ hashes[:-1]).tolist(), 1):
        out[k] = 65 - common.bit_length()
    return out


def word_shingles(text: str | None) -> set[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_LOWER))
    if len(words) < SHINGLE_WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE_WORDS))))


def _item_entries(threshold: float) -> Callable:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("item").to_pylist()
            for row, hashes in zip(rows, shingle_sets(batch.column("text"))):
                n = len(hashes)
                if not n:
                    continue
                need = needed(n, threshold)
                bits = least_bits(hashes) if need >= ALL_BELOW else np.zeros(n, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row)),
                        pa.array(np.full(n, need, np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(bits),
                    ],
                    ["item", "need", "hash", "bits"],
                )

    return entries


def bitmap_of(entries: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, two for each hash. What the driver gets does not grow."""
    both = entries.select(
        F.explode(
            F.array(
                F.col("hash").bitwiseAND(BITMAP_BITS - 1),
                F.shiftrightunsigned("hash", 40).bitwiseAND(BITMAP_BITS - 1),
            )
        ).alias("bit")
    )
    chunks = both.groupBy(F.floor(F.col("bit") / CHUNK_BITS).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("bit") % CHUNK_BITS).alias("bits")
    )
    whole = np.zeros(BITMAP_BITS // 8, np.uint8)
    for chunk, bits in chunks.collect():
        low = chunk * CHUNK_BITS // 8
        whole[low : low + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return whole


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for bit in (hashes & U64(BITMAP_BITS - 1), (hashes >> U64(40)) & U64(BITMAP_BITS - 1)):
        found &= (bitmap[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1
    return found


def _suspects(of_items, of_small_items) -> Callable:
    """Documents with a minimum, or any shingle of a small item, that an item may hold."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, small = of_items.value, of_small_items.value
        for batch in small_batches(batches):
            places, found, bits = [], [], []
            for place, hashes in enumerate(shingle_sets(batch.column("text"))):
                if not len(hashes):
                    continue
                k = size_class(len(hashes))
                use = is_minimum(hashes, k) & in_bitmap(large, hashes)
                use |= in_bitmap(small, hashes)
                if use.any():
                    places.append(place)
                    found.append(hashes[use].view(np.int64))
                    # Minima carry the number of bits, the others none.
                    bits.append(np.where(is_minimum(hashes, k)[use], k, 0).astype(np.int32))
            if places:
                some = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(ROW),
                        some.column("id"),
                        some.column("text"),
                        pa.array(found, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int32())),
                    ],
                    [ROW, "id", "text", "found", "bits"],
                )

    return suspects


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Common shingles of each pair, from the words themselves."""
    for batch in batches:
        last, mine, out = None, set(), []
        for row, text, item_text in zip(batch[ROW], batch["text"], batch["item_text"]):
            if row != last:
                last, mine = row, word_shingles(text)
            item = word_shingles(item_text)
            out.append((len(item), len(item & mine)))
        counts = pd.DataFrame(out, columns=["n_item", "n_shared"], index=batch.index)
        yield pd.concat([batch[[ROW, "id", "item", "item_id"]], counts], axis=1)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    item_id_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """Pairs of a document and an item of whose shingles it holds at least ``threshold``.

    Columns: _row (place in ``docs``), id, item (place in ``items``), item_id, n_item,
    n_shared, containment.
    """
    spark = docs.sparkSession
    tests = cut(
        with_row(items).select(
            F.col(ROW).alias("item"),
            F.col(item_id_column).cast("long").alias("item_id"),
            F.col(text_column).alias("text"),
        )
    )
    entries = cut(
        tests.select("item", "text").mapInArrow(
            _item_entries(threshold), "item long, need int, hash long, bits int"
        )
    )
    large = spark.sparkContext.broadcast(bitmap_of(entries))
    small = spark.sparkContext.broadcast(bitmap_of(entries.filter("bits = 0")))
    suspects = keep(
        with_row(docs)
        .select(ROW, F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(
            _suspects(large, small),
            f"{ROW} long, id long, text string, found array<long>, bits array<int>",
        ),
        "suspects",
    )
    met = suspects.select(ROW, F.explode(F.arrays_zip("found", "bits")).alias("m")).select(
        ROW, F.col("m.found").alias("hash"), F.col("m.bits").alias("doc_bits")
    )
    pairs = (
        met.join(entries, "hash")
        .filter("bits = 0 OR doc_bits >= bits")
        .groupBy(ROW, "item")
        .agg(F.count(F.lit(1)).alias("common"), F.first("need").alias("need"))
        .filter(F.col("common") >= F.greatest(F.lit(1), F.col("need") * SKETCH_SHARE))
        .select(ROW, "item")
    )
    texts = (
        pairs.join(suspects.select(ROW, "id", "text"), ROW)
        .join(tests.withColumnRenamed("text", "item_text"), "item")
        .select(ROW, "id", "text", "item", "item_id", "item_text")
    )
    return (
        texts.mapInPandas(
            _counted, f"{ROW} long, id long, item long, item_id long, n_item long, n_shared long"
        )
        .filter(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )
