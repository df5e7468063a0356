from __future__ import annotations

import numpy as np
import pytest

from monthweave.llm import quality_bayes as q
from tests.llm.cases import TEXTS, messy, nothing

FOLDER = "/root/testdata/sf0.01"


def test_labels_are_met(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    found = q.score_quality(docs, half).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    held = found.merge(labels.filter("doc_id % 2 = 1").toPandas(), left_on="id", right_on="doc_id")
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.97
    assert held[held.quality == 1].kept.mean() > 0.98


def test_sites_against_plain_python(spark):
    """Without telling texts the score is the shrunk rate of the site, less the own outcome."""
    rows = [(i, "same words here") for i in range(60)]
    docs = messy(spark, rows).withColumn("source", q.F.concat(q.F.lit("h"), q.F.col("doc_id") % 3))
    docs = docs.withColumn("lang", q.F.concat(q.F.lit("p"), q.F.col("doc_id") % 6)).drop("_row")
    labels = spark.createDataFrame([(i, int(i % 3 > 0 or i % 10 == 0)) for i in range(60)], "doc_id long, quality int")
    found = {r.id: r for r in q.score_quality(docs, labels).collect()}
    good = {i: float(i % 3 > 0 or i % 10 == 0) for i in range(60)}
    rate = sum(good.values()) / 60

    def anova(groups, centers):
        n = sum(len(g) for g in groups)
        between = sum(len(g) * (np.mean(g) - c) ** 2 for g, c in zip(groups, centers))
        within = sum(len(g) * c * (1 - c) for g, c in zip(groups, centers)) / n
        return n, between, within, n - sum(len(g) ** 2 for g in groups) / n

    hosts = [[good[i] for i in range(60) if i % 3 == h] for h in range(3)]
    n, between, within, size = anova(hosts, [rate] * 3)
    share = min(max((between - 2 * within) / (size * within), 1e-4), 1 - 1e-4)
    k = 1 / share - 1
    for i in (0, 1, 10):
        host = hosts[i % 3]
        want = (sum(host) - good[i] + k * rate) / (len(host) - 1 + k)
        assert abs(found[i].host_rate - want) < 1e-6
    assert found[1].path_rate > rate > found[3].path_rate


def test_fit_separates_and_survives_one_class():
    random = np.random.default_rng(1)
    x = random.normal(size=(500, q.FEATURES))
    y = (x[:, 2] > 0.3).astype(float)
    model = q.fit(x, y)
    odds = model.bias + np.concatenate([x, x**2], 1) @ np.array(model.weights)
    assert ((odds > 0) == (y == 1)).mean() > 0.97
    assert q.fit(x, np.ones(500)).weights == (0.0,) * (2 * q.FEATURES)
    assert q.fit(np.zeros((0, q.FEATURES)), np.zeros(0)).base == 0


@pytest.mark.parametrize("rows", [[], [(1, 1), (1, 0), (None, 1), (7, None), (2, 0), (99, 1)]])
def test_messy_rows(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int").selectExpr("*", "1 AS id", "2 AS good")
    found = q.score_quality(messy(spark), labels).collect()
    assert len(found) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found)
    assert q.score_quality(nothing(spark), labels).count() == 0


def test_null_sites(spark):
    docs = messy(spark).withColumn("source", q.F.lit(None).cast("string")).withColumn("lang", q.F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int")
    assert q.score_quality(docs, labels).count() == len(TEXTS)
