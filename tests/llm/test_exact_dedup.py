from __future__ import annotations

import hashlib
import re

from monthweave.llm.exact_dedup import DigestIndex
from monthweave.llm.queries import new_index
from tests.llm.cases import TEXTS, messy, nothing


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).digest()


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append((-len(t or ""), i is None, i))
    return {d: (min(g)[2], len(g)) for d, g in groups.items()}


def test_whole_table(spark):
    found = new_index(spark).deduplicate(messy(spark)).collect()
    want = expected(TEXTS)
    assert len(found) == len(TEXTS)
    for d, (keep_id, size) in want.items():
        rows = [r for r in found if bytes(r.digest) == d]
        assert len(rows) == size and {r.keep_id for r in rows} == {keep_id}
        assert {r.group_size for r in rows} == {size}
        assert [r.id for r in rows if r.kept] == [keep_id]


def test_more_code_points_win_then_the_smaller_id(spark):
    rows = [(5, "ab"), (4, "a b"), (3, "a b"), (2, "ab"), (1, "é"), (0, "ee")]
    found = {r.id: (r.keep_id, r.kept) for r in new_index(spark).deduplicate(messy(spark, rows)).collect()}
    assert found == {5: (3, False), 4: (3, False), 3: (3, True), 2: (3, False), 1: (1, True), 0: (0, True)}


def test_index_persists_and_later_batches_only_append_new_texts(spark):
    index = new_index(spark)
    index.deduplicate(messy(spark, [(1, "a"), (2, "b")])).collect()
    again = DigestIndex.open(spark, index.path, index.buckets)
    later = messy(spark, [(0, "a a"), (3, "c"), (4, " c"), (5, "a")])
    found = {r.id: (r.keep_id, r.kept, r.group_size) for r in again.deduplicate(later).collect()}
    assert found == {0: (0, True, 1), 3: (4, False, 2), 4: (4, True, 2), 5: (1, False, 1)}
    assert sorted(r.keep_id for r in index.rows().collect()) == [0, 1, 2, 4]


def test_anti_join_reads_the_index_without_shuffle(spark):
    index = new_index(spark)
    index.deduplicate(messy(spark)).collect()
    rows = index.rows()
    plan = rows.join(rows.hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_kept_rows_and_empty_table(spark):
    docs = messy(spark)
    kept = new_index(spark).kept_rows(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(expected(TEXTS)) and {r._row for r in rows} == {-1}
    assert new_index(spark).deduplicate(nothing(spark)).count() == 0
    assert new_index(spark).kept_rows(nothing(spark)).count() == 0


def test_a_batch_can_be_repeated(spark):
    """The same name again gets the same verdicts, also after a run that appended but told nothing."""
    index = new_index(spark)
    index.deduplicate(messy(spark, [(7, "a"), (8, "b")]), batch="first").collect()
    docs = messy(spark, [(0, " a "), (3, "c"), (4, " c"), (5, "d"), (6, None), (6, None)])
    verdicts = lambda: sorted(
        (r.id, r.keep_id, r.group_size, r.kept) for r in index.deduplicate(docs, batch="second").collect()
    )
    first = verdicts()
    assert first == [(0, 7, 1, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 2, False), (6, 6, 2, True)]
    assert verdicts() == first == verdicts()
    assert sorted(r.keep_id for r in index.rows().collect()) == [4, 5, 6, 7, 8]
    assert index.kept_rows(docs, batch="second").count() == 3
    # Another batch meets them as earlier ones.
    assert index.kept_rows(docs, batch="third").count() == 0


def test_a_batch_cut_short_loses_nothing(spark, monkeypatch):
    index = new_index(spark)
    docs = messy(spark, [(i, f"text {i % 40}") for i in range(100)])
    append = DigestIndex.append

    def half(self, rows):
        append(self, rows.filter("keep_id % 2 = 0"))
        raise RuntimeError("cut short")

    monkeypatch.setattr(DigestIndex, "append", half)
    try:
        index.deduplicate(docs, batch="one")
    except RuntimeError:
        pass
    monkeypatch.setattr(DigestIndex, "append", append)
    kept = index.kept_rows(docs, batch="one").collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert index.rows().count() == 40


def test_a_frequent_digest_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        docs = messy(spark, [(i, None if i % 3 else f"text {i}") for i in range(9000)], 8)
        found = new_index(spark).deduplicate(docs)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan
    assert sum(r.kept for r in rows) == 3001 and {r.group_size for r in rows if r.keep_id == 1} == {6000}
