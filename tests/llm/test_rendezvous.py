from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from monthweave.llm import rendezvous
from monthweave.llm.rendezvous import shard_texts, with_shards, with_slots
from tests.llm.cases import TEXTS, messy, nothing


def test_sizes_checksums_and_slots(spark):
    found = shard_texts(messy(spark), [1.0] * 5).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert shard_texts(nothing(spark), [1.0] * 5).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(20000)
    old = with_shards(keys, "id", [1.0] * 24)
    new = with_shards(keys, "id", [1.0] * 25).select("id", F.col("shard").alias("later"))
    rows = old.join(new, "id").collect()
    assert all(r.grown_shard == r.later for r in rows)
    assert all(r.later in (r.shard, 24) for r in rows)
    moved = sum(r.later != r.shard for r in rows)
    assert abs(moved - 800) < 150
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 24 and max(counts.values()) < 1.2 * 20000 / 24


def test_weights_share_the_keys(spark):
    rows = with_shards(spark.range(30000), "id", [1.0, 2.0, 0.0, 3.0]).groupBy("shard").count().collect()
    counts = {r.shard: r["count"] / 30000 for r in rows}
    assert set(counts) == {0, 1, 3}
    assert all(abs(counts[s] - w / 6) < 0.02 for s, w in ((0, 1), (1, 2), (3, 3)))


def test_slots_do_not_depend_on_the_number_of_pieces(spark):
    rows = with_shards(spark.range(3000), "id", [1.0] * 3)
    one = {(r.id, r.slot) for r in with_slots(rows, "id", bits=1).collect()}
    many = {(r.id, r.slot) for r in with_slots(rows, "id", bits=12).collect()}
    assert one == many and len(one) == 3000


def test_rows_of_one_key_are_in_many_pieces(spark):
    rows = [(None if i % 3 else i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slots = [r.slot for r in shard_texts(docs, [1.0]).collect() if r.doc_id is None]
    assert len(set(slots)) == 2000
    # In each hundredth of the slots are some of them and some of the others.
    assert all(0 < n < 30 for n in Counter(s // 30 for s in slots).values())
    assert len({s // 30 for s in slots}) == 100


def test_equal_rows_are_counted_before_they_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(rendezvous, "RUN", 7)
    docs = messy(spark, [(5, "equal")] * 1000 + [(None, "equal")] * 20 + [(i, "x") for i in range(300)])
    placed = shard_texts(docs, [1.0] * 2)
    found = placed.collect()
    assert Counter((r.doc_id, r.text_crc32) for r in found) == Counter(
        (r.doc_id, zlib.crc32(r.text.encode())) for r in docs.collect()
    )
    for shard in (0, 1):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    window = placed._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert "Aggregate [" in window and "count(1)" in window


def test_runs_no_python(spark):
    plan = shard_texts(messy(spark), [1.0] * 24)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_the_shard_with_the_least_draw_wins(spark):
    """Draws computed here from the hash's definition: each value is hashed with the hash so far as its seed."""
    import math
    import struct

    import xxhash

    weights = [1.0, 2.5, 0.0, 0.5, 1.0]

    def draw(key, shard):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return -math.log(((h >> 11) + 0.5) / 2**53)

    keys = [None, -1, 0, 2**62, *range(1, 500)]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    for r in with_shards(df, "id", weights, grown_weight=2.0).collect():
        draws = {s: draw(r.id, s) / w for s, w in enumerate(weights) if w}
        assert r.shard == min(draws, key=draws.get)
        grown = {**draws, 5: draw(r.id, 5) / 2.0}
        assert r.grown_shard == min(grown, key=grown.get)
