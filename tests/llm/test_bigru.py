from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from monthweave.llm import bigru, queries
from monthweave.llm.words import text_bytes
from tests.llm.cases import TEXTS, messy, nothing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return queries.language_model(docs)


def test_held_out_accuracy(spark, docs, model):
    found = bigru.identify(docs, model).filter(queries.remainder("doc_id", 4) == 2).toPandas()
    assert len(found) > 150
    assert (found.lang_pred == found.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_gradients_match_differences():
    net = bigru._Trained(3, seed=1)
    net.weights[:] = [w.astype(np.float64) for w in net.weights]
    net.byte, net.state = net.weights[0:2], net.weights[2:4]
    net.out, net.bias = net.weights[4:6]
    random = np.random.default_rng(2)
    data, labels = random.integers(0, 256, (7, 4)), np.array([0, 1, 2, 1])
    valid = np.arange(7)[:, None] < np.array([7, 5, 7, 3])
    seen = {}
    net._adam = lambda grads: seen.update(grads=[g.copy() for g in grads])
    net.learn(data, labels, valid)
    for which, place in ((0, (data[1, 0], 3)), (2, (4, 20)), (3, (1, 9)), (4, (5, 1)), (5, (2,))):
        w, got = net.weights[which], seen["grads"][which][place]
        losses = []
        for move in (1e-5, -2e-5):
            w[place] += move
            losses.append(net.learn(data, labels, valid) if move > 0 else net.learn(data, labels, valid))
        w[place] += 1e-5
        assert abs((losses[0] - losses[1]) / 2e-5 - got) < 2e-3 + 0.02 * abs(got)


def test_windows_do_not_depend_on_neighbours(model):
    texts = ["the and of " * 40, "", "de la que " * 3, "und der die " * 200]
    data, starts = text_bytes(pa.array(texts))
    whole = bigru.pooled(model, data, starts)
    for i, text in enumerate(texts):
        alone = bigru.pooled(model, *text_bytes(pa.array([text])))
        assert np.allclose(alone[0], whole[i], atol=1e-5)


def test_messy_rows(spark, model):
    docs = messy(spark)
    found = bigru.identify(docs, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(TEXTS) and {r._row for r in rows} == {-1}
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.languages) if letters else (r.lang_pred, r.score) == ("und", 0.0)


def test_nothing_to_learn_from(spark, model):
    assert bigru.fit(nothing(spark)) is None
    assert {(r.lang_pred, r.score) for r in bigru.identify(messy(spark), None).collect()} == {("und", 0.0)}
    assert bigru.identify(nothing(spark), model).count() == 0


def test_sample_of_any_rows(spark, docs):
    """Null ids, repeated rows, many languages and a column named as the sample's own."""
    texts = [r.text for r in docs.filter("lang is not null and text <> ''").limit(60).collect()]
    rows = [(None, t, f"language {i % 30}") for i, t in enumerate(texts) for _ in range(3)] + [(1, "", "empty"), (2, "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS mark", "2 AS place", "3 AS _picked", "4 AS label"
    )
    sample = bigru.sample_of(table, "doc_id", "text", "lang")
    assert sorted({label for _, label in sample}) == sorted({f"language {i}" for i in range(30)})
    assert len(sample) == len({(t, i % 30) for i, t in enumerate(texts)})
    assert all(window and any(window in t for t in texts) for window, _ in sample)
    assert bigru.sample_of(table.repartition(7), "doc_id", "text", "lang") == sample


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(bigru, "SAMPLE_DOCS", 20)
    table = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 3 = 0, 'a', 'b') AS lang")
    labels = [label for _, label in bigru.sample_of(table, "doc_id", "text", "lang")]
    assert (labels.count("a"), labels.count("b")) == (20, 20)


def test_same_splits_for_other_cores(spark):
    from monthweave.llm.storage import LEAST_PARTITIONS, hold_splits

    hold_splits(spark)
    assert spark.conf.get(LEAST_PARTITIONS) == str(spark.sparkContext.defaultParallelism)
    spark.conf.set(LEAST_PARTITIONS, "3")
    hold_splits(spark)
    assert spark.conf.get(LEAST_PARTITIONS) == "3"
    spark.conf.unset(LEAST_PARTITIONS)


def by_equations(model, text):
    """Mean over the bytes of what the two directions say, byte after byte in double precision."""
    size, total, n = bigru.HIDDEN, 0.0, 0
    gate = lambda x: min(1.0, max(0.0, 0.25 * x + 0.5))
    squash = lambda x: x / (1 + abs(x))

    def states(direction, window):
        byte, weights = direction.byte.astype(float), direction.state.astype(float)
        h, out = np.zeros(size), []
        for x in window:
            past = h @ weights
            update = np.array([gate(v) for v in byte[x, :size] + past[:size]])
            reset = np.array([gate(v) for v in byte[x, size : 2 * size] + past[size : 2 * size]])
            new = np.array([squash(v) for v in byte[x, 2 * size :] + reset * past[2 * size :]])
            h = (1 - update) * h + update * new
            out.append(h)
        return out

    for low in range(0, len(text), bigru.WINDOW):
        window = list(text[low : low + bigru.WINDOW])
        ahead, behind = states(model.forward, window), states(model.backward, window[::-1])[::-1]
        for a, b in zip(ahead, behind):
            logits = np.concatenate([a, b]) @ model.out.astype(float) + model.bias
            chance = np.exp(logits - logits.max())
            total, n = total + chance / chance.sum(), n + 1
    return total / n


def test_forward_pass_is_that_of_the_equations(model):
    texts = ["a", "the and of it is", "été de la que " * 9, "x" * 128, "und der " * 40, "中文\x00 zz" * 20]
    found = bigru.pooled(model, *text_bytes(pa.array(texts)))
    for got, text in zip(found, texts):
        assert np.allclose(got, by_equations(model, text.encode()), atol=2e-4)
