from __future__ import annotations

import os
import struct

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from monthweave.llm import queries
from monthweave.llm.storage import keep, shared_folder
from tests.llm.cases import messy, nothing, shingles
from tests.llm.test_byte_bpe import PATH, library  # noqa: F401
from tests.llm.test_exact_dedup import digest
from tests.llm.test_near_dedup import roots

FOLDER = "/root/testdata/sf0.001"


def plain_run(docs, items):
    """The stages after language ID on (id, text) rows, by brute force."""
    best = {}
    for i, t in docs:
        k = digest(t)
        if k not in best or (-len(t), i) < (-len(best[k][1]), best[k][0]):
            best[k] = (i, t)
    rows = sorted(best.values())
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    rows = [r for i, r in enumerate(rows) if roots(len(rows), links)[i] == i]
    wanted = [s for s in (shingles(t) for _, t in items) if s]
    return [
        (i, t) for i, t in rows if not any(len(s & shingles(t)) >= 0.75 * len(s) - 1e-9 for s in wanted)
    ]


def test_run_against_brute_force(spark, library):  # noqa: F811
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    read = lambda n: queries.read(spark, FOLDER, n)
    # All texts of this table have letters; the network's verdicts have their own test.
    clear = corpus_pipeline.language(spark, read("documents"), FOLDER)
    docs = [(r.doc_id, r.text) for r in clear.collect()]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    want = dict(plain_run(docs, items))
    assert set(found) == set(want)
    for i, text in want.items():
        ids = library.encode_ordinary(text)
        assert found[i].text == text and found[i].n_tokens == len(ids)
        assert bytes(found[i].ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_stages_keep_columns_and_clean_documents(spark):
    docs = queries.read(spark, FOLDER, "documents")
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


@pytest.mark.parametrize("make", [messy, nothing])
def test_messy_tables(spark, make):
    docs = make(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars", "key")
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, FOLDER), "stage")
    rows = docs.collect()
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    if make is messy:
        assert {r.doc_id for r in rows} >= {None, 7, 11, 13, 14, 16} and not {4, 5, 6, 15} & {r.doc_id for r in rows}


def test_columns_named_as_results_stay(spark):
    """A table with a score, a prediction and working names of its own leaves the language stage as it came."""
    own = ["score", "lang_pred", "_letters", "_picked", "column0", "mark", "a name, with <marks>"]
    docs = queries.read(spark, FOLDER, "documents").select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in own])
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    rows = {tuple(r) for r in docs.collect()}
    found = [tuple(r) for r in kept.collect()]
    assert len(found) >= 0.99 * len(rows) and set(found) <= rows


def python_steps(plan):
    """The most steps in Python that one task of the plan runs side by side."""
    name, below = plan.nodeName(), plan.children()
    most = max((python_steps(below.apply(i)) for i in range(below.size())), default=0)
    return most + any(kind in name for kind in ("InArrow", "InPandas", "EvalPython"))


def test_tokens_need_one_python_worker_a_task(spark):
    """Ids are decoded from where they were written, not beside a worker that still encodes."""
    docs = queries.read(spark, FOLDER, "documents")
    found = corpus_pipeline.tokens(spark, docs, FOLDER)
    assert python_steps(found._jdf.queryExecution().optimizedPlan()) == 1
    rows = {r.doc_id: r for r in found.collect()}
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {i: r.text for i, r in rows.items()} == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows.values())


def left_behind(spark, stage):
    """The stage's rows, and what folders it leaves for them."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = stage(spark, queries.read(spark, FOLDER, "documents"), FOLDER).collect()
    return rows, {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before if "-" in n and n.startswith(("digests", "monthweave"))}


def test_stages_leave_only_what_their_rows_are_read_from(spark):
    """No later stage holds the disk of an index that nothing can open again, or of sets that were compared."""
    best = {}
    for r in queries.read(spark, FOLDER, "documents").collect():
        best[digest(r.text)] = max(best.get(digest(r.text), (0, 0)), (len(r.text or ""), -r.doc_id))
    tables = len(spark.catalog.listTables())
    rows, folders = left_behind(spark, corpus_pipeline.exact_copies)
    assert {r.doc_id for r in rows} == {-i for _, i in best.values()} and len(rows) == len(best)
    assert folders == set() and len(spark.catalog.listTables()) == tables
    rows, folders = left_behind(spark, corpus_pipeline.near_copies)
    assert rows and folders == {"monthweave-minima"}
