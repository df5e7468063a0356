"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier of the text's form gives each document's evidence: the log odds it adds to
those of the training rows. Sites add what their other documents are like: every document
counts with its label, or with the classifier's probability where it has none, and grouped
sums give the rate of each host and of each path within it. A host's rate is shrunk
toward the global one, a path's toward its host's, with strengths estimated from the spread of the rates over
all sites (intraclass correlation), so sparse sites say little. A document's own
outcome is left out of its sites. The posterior log odds are the evidence plus the log odds of the path.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents, taken by a hash of their
ids; all else covers all rows.

Cases: a null text counts as empty; a null host or path is a site of its own. Several labels of one id
are averaged, half counting as good. Without labels of both kinds the evidence is 0 and
every rate one half or the one label's. Repeated rows are scored each and null ids carried
along. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, cut, hash_below, keep, with_row
from monthweave.llm.words import small_batches, text_bytes, word_hashes, word_places

SAMPLE_ROWS = 20_000
RIDGE = 1.0
ROUNDS = 12
FEATURES = 12
_EPS = 1e-6

_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[ord("0") : ord("9") + 1] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 1
_RARE = _MARK.copy()
_RARE[list(b".,;:!?'\"()-")] = 0
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1


def _by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct_share(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values of each row over their number; 1 for rows without any."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    counts = np.diff(bounds)
    return np.where(counts, np.bincount(r[new], minlength=len(counts)) / np.maximum(counts, 1), 1.0)


def text_features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows x FEATURES measures of form, each of order one."""
    first, end = word_places(data, starts)
    bounds = np.searchsorted(first, starts)
    words, size = np.maximum(np.diff(bounds), 1), np.maximum(np.diff(starts), 1)
    hashes = word_hashes(data, first, end)
    row = np.repeat(np.arange(len(size)), np.diff(bounds))
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    lone = ((end - first) == 1) & (_RARE[data[first]] == 1) if len(first) else np.zeros(0, bool)
    breaks = np.flatnonzero(data == 10)
    line_first = np.unique(np.concatenate([starts[:-1], breaks + 1]))
    line_first = line_first[line_first < len(data)]
    # A line is told by the sum of its words' hashes.
    line_of = np.searchsorted(line_first, first, "right") - 1
    line_hash = np.zeros(len(line_first), np.uint64)
    np.add.at(line_hash, line_of, hashes)
    line_bounds = np.searchsorted(line_first, starts)
    letters = np.maximum(size - _by_row(_MARK[data] + _DIGIT[data], starts), 1)
    return np.stack(
        [
            np.log1p(np.diff(bounds)) / 5,
            (_by_row(end - first, bounds) / words) / 8,
            _by_row(_UPPER[data], starts) / letters * 4,
            _by_row(_DIGIT[data], starts) / size * 10,
            _by_row(_MARK[data], starts) / size * 10,
            _by_row(_RARE[data], starts) / size * 10,
            _by_row(_SHOUT[data], starts) / size * 10,
            _by_row(again, bounds) / words * 2,
            _distinct_share(hashes, bounds),
            _distinct_share(line_hash, line_bounds),
            _by_row(lone.astype(np.int64), bounds) / words * 4,
            np.log1p(np.diff(line_bounds)) / 4,
        ],
        1,
    )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = text_features(*text_bytes(batch.column("text")))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(list(found), pa.list_(pa.float64()))],
            [*names, "features"],
        )


@dataclass(frozen=True)
class Classifier:
    """Log odds are ``bias`` plus the products of features and their squares with the weights."""

    bias: float
    weights: tuple[float, ...]
    base: float  # log odds of the training rows

    def log_odds(self, features: Column) -> Column:
        total = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            x = features[i % FEATURES]
            total = total + (x * x if i >= FEATURES else x) * F.lit(w)
        return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def fit(features: np.ndarray, good: np.ndarray) -> Classifier:
    """Ridge logistic regression by reweighted least squares, on standardised columns."""
    rate = (good.sum() + 0.5) / (len(good) + 1) if len(good) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if not len(good) or good.min() == good.max():
        return Classifier(base, (0.0,) * (2 * FEATURES), base)
    wide = np.concatenate([features, features**2], 1)
    mean, spread = wide.mean(0), wide.std(0) + _EPS
    x = np.concatenate([np.ones((len(wide), 1)), (wide - mean) / spread], 1)
    weights = np.zeros(x.shape[1])
    weights[0] = base
    pull = np.full(len(weights), RIDGE)
    pull[0] = 0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (good - p) - pull * weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull + 1e-9)
        weights = weights + np.clip(np.linalg.solve(curve, slope), -4, 4)
    scaled = weights[1:] / spread
    return Classifier(float(weights[0] - scaled @ mean), tuple(map(float, scaled)), base)


def _odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - _EPS)), F.lit(_EPS))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, n: str, s: str, center: Column, parents: int) -> float:
    """Prior observations a site's center is worth, from the spread of rates around it.

    The analysis-of-variance estimate of the intraclass correlation, kept off 0 and 1.
    """
    rate = F.col(s) / F.col(n)
    inner = center * (1 - center)
    row = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(F.col(n) * F.col(n)).alias("nn"),
        F.sum(F.col(n) * (rate - center) ** 2).alias("between"),
        F.sum(F.col(n) * inner).alias("within"),
    ).first()
    if not row.k or row.k <= parents or not row.within:
        return 1 / _EPS
    variance = row.within / row.n
    size = row.n - row.nn / row.n
    share = (row.between - (row.k - parents) * variance) / max(size * variance, _EPS)
    share = min(max(share, 1e-4), 1 - 1e-4)
    return 1 / share - 1


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    host_column: str = "source",
    path_column: str = "lang",
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> DataFrame:
    """Columns _row (place in ``docs``), id, evidence, host_rate, path_rate, score, kept."""
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    described = keep(
        with_row(docs)
        .select(
            ROW,
            F.col(id_column).cast("long").alias("id"),
            site(host_column).alias("host"),
            site(path_column).alias("path"),
            F.col(text_column).alias("text"),
        )
        .mapInArrow(
            _describe, f"{ROW} long, id long, host string, path string, features array<double>"
        ),
        "features",
    )
    marked = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).cast("long").alias("id"))
        .agg((F.avg(label_column) >= 0.5).cast("double").alias("good"))
    )
    mark = F.xxhash64("id", F.lit("fit"))
    chosen = hash_below(mark, SAMPLE_ROWS, marked.count())
    sample = (
        described.filter(chosen)
        .join(marked.filter(chosen), "id")
        .select("features", "good", mark.alias("mark"), ROW)
        .orderBy("mark", ROW)
        .limit(SAMPLE_ROWS)
        .collect()
    )
    model = fit(
        np.array([r.features for r in sample]).reshape(-1, FEATURES),
        np.array([r.good for r in sample]),
    )
    odds = model.log_odds(F.col("features"))
    rows = cut(
        described.join(marked, "id", "left").select(
            ROW,
            "id",
            "host",
            "path",
            (odds - model.base).alias("evidence"),
            F.coalesce("good", 1 / (1 + F.exp(-odds))).alias("outcome"),
        )
    )
    paths = cut(
        rows.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("path_n"), F.sum("outcome").alias("path_s")
        )
    )
    hosts = cut(
        paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    )
    all_n, all_s, host_count = hosts.agg(
        F.sum("host_n"), F.sum("host_s"), F.count(F.lit(1))
    ).first()
    rate = all_s / all_n if all_n else 0.5
    host_k = strength(hosts, "host_n", "host_s", F.lit(rate), 1)
    sites = paths.join(hosts, "host")
    path_k = strength(sites, "path_n", "path_s", F.col("host_s") / F.col("host_n"), host_count)
    own = F.col("outcome")
    host_rate = (F.col("host_s") - own + host_k * rate) / (F.col("host_n") - 1 + host_k)
    path_rate = (F.col("path_s") - own + path_k * F.col("host_rate")) / (F.col("path_n") - 1 + path_k)
    return (
        rows.join(sites, ["host", "path"])
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate"))))))
        .select(
            ROW, "id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept")
        )
    )
