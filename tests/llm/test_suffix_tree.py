from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from monthweave.llm import queries, suffix_tree as st
from tests.llm.cases import TEXTS, messy, nothing, words

FOLDER = "/root/testdata/sf0.01"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_score(tree, text):
    """Log10 probability with every distribution worked out from the longest suffix."""
    place = {(n, c): i for i, (n, c) in enumerate(zip(tree.lengths.tolist(), tree.contexts.tolist()))}
    column = {s: i for i, s in enumerate(tree.symbols.tolist())}

    def chance(length, code, symbol):
        i = place[(length, code)]
        less = chance(length - 1, code & ((1 << 9 * (length - 1)) - 1), symbol) if length else 1 / 257
        n = tree.counts[i]
        seen = n[column[symbol]] if symbol in column else 0
        return (seen + st.SMOOTHING * less) / (n.sum() + st.SMOOTHING)

    sequence = [0] * tree.depth + [b + 1 for b in low(text).encode()] + [257]
    total = 0.0
    for i in range(tree.depth, len(sequence)):
        for length in range(tree.depth, -1, -1):
            code = 0
            for s in sequence[i - length : i]:
                code = code << 9 | s
            if (length, code) in place:
                total += math.log10(chance(length, code, sequence[i]))
                break
    return total


def test_unigram_base_and_tree(spark, monkeypatch):
    monkeypatch.setattr(st, "HEAD", 300)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150).collect()]
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(TEXTS) if len(t or "") < 2000] + [(None, "Null id")]
    docs = messy(spark, rows)
    learn = docs.filter(queries.remainder("doc_id", 7) != 2)
    model = st.train(learn, head=300)
    count = Counter()
    for r in learn.collect():
        count.update([*words(r.text), None])
    assert (model.total, model.distinct) == (sum(count.values()), len(count))
    found = {r.id: r for r in st.score(docs, model).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        tokens, r = [*words(text), None], found[i]
        base = sum(math.log10((count[w] + 1) / (model.total + model.distinct + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(count[w] > 0 for w in tokens))
        assert abs(r.base_score - base) < 1e-7 * abs(base) + 1e-9
    for i, text in rows[:12] + rows[150:]:
        if len(text or "") < 3000:
            want = plain_score(model.tree, text)
            assert abs(found[i].score - want) < 1e-4 * abs(want) + 1e-5


def test_contexts_are_those_that_diverge(spark):
    docs = messy(spark, [(i, "abab" * 300 + "cbcb" * 300) for i in range(3)])
    tree = st.train(docs, depth=2).tree
    code = lambda s: sum((ord(c) + 1) << 9 * k for k, c in enumerate(reversed(s)))
    held = set(zip(tree.lengths.tolist(), tree.contexts.tolist()))
    # After b comes a or c, which only the symbol before b tells.
    assert {(0, 0), (1, code("a")), (1, code("b")), (2, code("ab")), (2, code("cb"))} <= held
    assert (2, code("ba")) not in held


@pytest.mark.parametrize("held, bits", [(1, 1 << 27), (40, 1 << 27), (200, 1 << 10)])
def test_contexts_beyond_the_head_score_alike(spark, monkeypatch, held, bits):
    monkeypatch.setattr(st, "TAIL_BITS", bits)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    docs = messy(spark, rows + TEXTS)
    learn = docs.filter(queries.remainder("doc_id", 7) != 2)
    whole, parted = st.train(learn), st.train(learn, head_contexts=held)
    assert whole.tail is None and len(parted.tree.contexts) <= max(held, 1)
    tail = parted.tail.contexts.collect()
    kept = lambda tree: set(zip(tree.lengths.tolist(), tree.contexts.tolist()))
    assert kept(whole.tree) == kept(parted.tree) | {(r.length, r.context) for r in tail}
    want = {r._row: r.score for r in st.score(docs, whole).collect()}
    found = {r._row: r.score for r in st.score(docs, parted).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[i] - want[i]) < 1e-5 * abs(want[i]) + 1e-5 for i in want)


def test_segments_do_not_change_scores(spark, monkeypatch):
    docs = messy(spark, [(1, "the cat sat on the mat. " * 60), (2, "the dog")])
    tree = st.train(docs).tree
    machine = st.automaton(tree)
    data = np.frombuffer(b"the cat sat on the dog " * 50, np.uint8)
    symbols, begins = st.symbols_of(data, np.array([0, 7, 7, len(data)]), tree.depth)
    whole = st.tree_scores(machine, symbols, begins, tree.depth)
    monkeypatch.setattr(st, "SEGMENT", 7)
    assert np.allclose(st.tree_scores(machine, symbols, begins, tree.depth), whole, atol=1e-3)


def test_probabilities_sum_to_one(spark):
    tree = st.train(messy(spark)).tree
    machine = st.automaton(tree)
    unseen = 257 - len(tree.symbols)
    chances = 10.0 ** machine.logs.astype(float)
    known = [machine.classes[s] for s in tree.symbols]
    total = chances[:, known].sum(1) + unseen * chances[:, len(tree.symbols) + 1]
    assert np.allclose(total, 1, atol=1e-4)


def test_messy_rows_and_empty_tables(spark):
    docs = messy(spark)
    model = st.train(docs)
    found = st.score(docs, model).collect()
    assert len(found) == len(TEXTS) and all(r.n_tokens == r.n_known and r.score < 0 for r in found)
    assert st.score(nothing(spark), model).count() == 0
    none = st.train(nothing(spark))
    assert (none.total, none.distinct) == (0, 0)
    found = {r.id: r for r in st.score(docs, none).collect()}
    assert found[7].base_score == 0 and found[7].n_known == 0
    assert abs(found[7].score - 4 * math.log10(1 / 257)) < 1e-5


@pytest.mark.parametrize("held", [2])
def test_tallies_give_way_when_full(spark, monkeypatch, held):
    docs = messy(spark, TEXTS[:8])
    want = {(r.kind, r.key, r.n) for r in counts(docs)}
    monkeypatch.setattr(st, "HELD", held)
    assert {(r.kind, r.key, r.n) for r in counts(docs)} == want


def counts(docs):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([r.text for r in docs.collect()], pa.string())})
    total = Counter()
    for part in st._count(3)(iter([batch])):
        for k, c, n in zip(*(part.column(x).to_pylist() for x in ("kind", "key", "n"))):
            total[(k, c)] += n
    from types import SimpleNamespace

    return [SimpleNamespace(kind=k, key=c, n=n) for (k, c), n in total.items()]
