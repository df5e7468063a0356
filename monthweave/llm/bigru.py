"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of 128 bytes, forwards and backwards, and gives
every byte a probability for each language; a text's probability is the mean over all of its bytes.
It is trained in numpy by backpropagation through time on a bounded sample: a window of
``SAMPLE_CHARS`` characters from each of at most ``SAMPLE_DOCS`` labelled documents of every
language, taken by a hash of id and text.

Cases: a null text or one without a letter is ``und`` with score 0. Without any labelled
text every text is. Repeated rows are labelled each, and learned from once; null ids are learned from
like others. All other columns are carried along, but for ``lang_pred`` and ``score``, which are replaced. An empty
table gives no rows. Ties between languages go to the first in order. A very long text is read
whole, as a batch of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthweave.llm.storage import hash_below, ship_code
from monthweave.llm.words import small_batches, text_bytes

UNDETERMINED = "und"
SAMPLE_DOCS = 256
SAMPLE_CHARS = 192
HIDDEN = 8
WINDOW = 128
TRAIN_WINDOW = 96
#: Windows run side by side.
BLOCK = 4096
STEPS = 240
BATCH = 192
RATE = 0.02

F32 = np.float32


@dataclass(frozen=True)
class Direction:
    """Weights of one reading direction: three gates side by side (update, reset, state)."""

    byte: np.ndarray  # 256 x 3 HIDDEN, bias included
    state: np.ndarray  # HIDDEN x 3 HIDDEN


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    forward: Direction
    backward: Direction
    out: np.ndarray  # 2 HIDDEN x languages
    bias: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    """Logistic gate in three straight pieces."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _run(direction: Direction, data: np.ndarray, active: np.ndarray, backwards: bool) -> np.ndarray:
    """States after each step; ``data`` is steps x windows, the longest windows first.

    ``active[t]`` windows reach step t. The three gates are kept apart, so that every
    array is contiguous.
    """
    steps, width = data.shape
    byte = [np.ascontiguousarray(p) for p in np.split(direction.byte, 3, 1)]
    state = [np.ascontiguousarray(p) for p in np.split(direction.state, 3, 1)]
    byte[0], state[0] = byte[0] * F32(0.25) + F32(0.5), state[0] * F32(0.25)
    byte[1], state[1] = byte[1] * F32(0.25) + F32(0.5), state[1] * F32(0.25)
    out = np.zeros((steps, width, HIDDEN), F32)
    h = np.zeros((width, HIDDEN), F32)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        n = active[t]
        x, now = data[t, :n], h[:n]
        z = now @ state[0]
        z += byte[0].take(x, 0, mode="clip")
        np.clip(z, 0, 1, out=z)
        r = now @ state[1]
        r += byte[1].take(x, 0, mode="clip")
        np.clip(r, 0, 1, out=r)
        c = now @ state[2]
        c *= r
        c += byte[2].take(x, 0, mode="clip")
        np.abs(c, out=r)
        r += 1
        c /= r
        c -= now
        c *= z
        now += c
        out[t, :n] = now
    return out


def position_probabilities(model: Model, data: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Steps x windows x languages; rows behind the end of a window mean nothing."""
    logits = _run(model.forward, data, active, False) @ model.out[:HIDDEN]
    logits += _run(model.backward, data, active, True) @ model.out[HIDDEN:]
    logits += model.bias
    np.subtract(logits, logits.max(2, keepdims=True), out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(2, keepdims=True)
    return logits


def pooled(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean probabilities of each row of bytes; a row without bytes has zeros."""
    sizes = np.diff(starts)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = starts[row] + place * WINDOW
    length = np.minimum(starts[row + 1] - low, WINDOW)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((len(sizes), len(model.languages)))
    for at in range(0, len(order), BLOCK):
        pick = order[at : at + BLOCK]
        steps = np.arange(length[pick[0]])
        block = data[np.minimum(low[pick] + steps[:, None], len(data) - 1)].astype(np.intp)
        active = (length[pick] > steps[:, None]).sum(1)
        found = position_probabilities(model, block, active)
        found *= (length[pick] > steps[:, None])[:, :, None]
        np.add.at(total, row[pick], found.sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


class _Trained:
    """Parameters during training, with the passes back through time."""

    def __init__(self, languages: int, seed: int = 5):
        random = np.random.default_rng(seed)
        draw = lambda *shape: random.normal(0, 0.3, shape).astype(F32)
        self.byte = [draw(256, 3 * HIDDEN), draw(256, 3 * HIDDEN)]
        self.state = [draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)]
        self.out, self.bias = draw(2 * HIDDEN, languages), np.zeros(languages, F32)
        self.weights = [*self.byte, *self.state, self.out, self.bias]
        self.first = [np.zeros_like(w) for w in self.weights]
        self.second = [np.zeros_like(w) for w in self.weights]
        self.step = 0

    def _forward(self, k: int, data: np.ndarray):
        steps, width = data.shape
        h = np.zeros((width, HIDDEN), F32)
        trace = []
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            a, u = self.byte[k][data[t]], h @ self.state[k]
            gates = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
            zr = _gate(gates)
            z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], u[:, 2 * HIDDEN :]
            raw = a[:, 2 * HIDDEN :] + r * inner
            c = _squash(raw)
            trace.append((t, h, gates, z, r, inner, raw, c))
            h = h + z * (c - h)
        hidden = np.zeros((steps, width, HIDDEN), F32)
        for (t, *_), after in zip(trace, [x[1] for x in trace[1:]] + [h]):
            hidden[t] = after
        return hidden, trace

    def _back(self, k: int, data: np.ndarray, trace: list, d_hidden: np.ndarray):
        d_byte, d_state = np.zeros_like(self.byte[k]), np.zeros_like(self.state[k])
        dh = np.zeros_like(trace[0][1])
        for t, h, gates, z, r, inner, raw, c in reversed(trace):
            dh = dh + d_hidden[t]
            d_raw = dh * z / (1 + np.abs(raw)) ** 2
            d_gate = np.concatenate([dh * (c - h), d_raw * inner], 1) * 0.25
            d_gate *= np.abs(gates) < 2
            d_in = np.concatenate([d_gate, d_raw], 1)
            d_u = np.concatenate([d_gate, d_raw * r], 1)
            d_state += h.T @ d_u
            np.add.at(d_byte, data[t], d_in)
            dh = dh * (1 - z) + d_u @ self.state[k].T
        return d_byte, d_state

    def learn(self, data: np.ndarray, labels: np.ndarray, valid: np.ndarray) -> float:
        """One step on windows (steps x windows) whose every valid position has the window's label."""
        hidden, traces = zip(*(self._forward(k, data) for k in (0, 1)))
        both = np.concatenate(hidden, 2)
        logits = both @ self.out + self.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        count = max(1, int(valid.sum()))
        columns = np.arange(data.shape[1])
        loss = -np.log(np.maximum(p[:, columns, labels], 1e-9))[valid].sum() / count
        p[:, columns, labels] -= 1
        p *= valid[:, :, None] / F32(count)
        d_both = p @ self.out.T
        grads_byte, grads_state = zip(
            *(
                self._back(k, data, traces[k], d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN])
                for k in (0, 1)
            )
        )
        flat = p.reshape(-1, p.shape[2])
        grads = [*grads_byte, *grads_state, both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)]
        self._adam(grads)
        return float(loss)

    def _adam(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - self.step / (STEPS + 1)))
        for w, g, m, v in zip(self.weights, grads, self.first, self.second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)

    def model(self, languages: tuple[str, ...]) -> Model:
        sides = [Direction(b.astype(F32), s.astype(F32)) for b, s in zip(self.byte, self.state)]
        return Model(languages, *sides, self.out.astype(F32), self.bias.astype(F32))


def train(samples: list[tuple[str, str]]) -> Model | None:
    """A model from (text, language) samples; None without any."""
    samples = sorted((s for s in samples if s[0]), key=lambda s: (s[1], s[0]))
    languages = tuple(sorted({s[1] for s in samples}))
    if not languages:
        return None
    windows, labels = [], []
    for text, language in samples:
        data = text.encode()
        for low in range(0, max(1, len(data) - TRAIN_WINDOW // 2), TRAIN_WINDOW):
            windows.append(np.frombuffer(data[low : low + TRAIN_WINDOW], np.uint8))
            labels.append(languages.index(language))
    labels = np.array(labels)
    padded = np.zeros((len(windows), TRAIN_WINDOW), np.intp)
    valid = np.zeros((len(windows), TRAIN_WINDOW), bool)
    for i, w in enumerate(windows):
        padded[i, : len(w)], valid[i, : len(w)] = w, True
    # Each step draws every language alike.
    share = 1 / np.bincount(labels, minlength=len(languages))[labels]
    random, net = np.random.default_rng(11), _Trained(len(languages))
    for _ in range(STEPS):
        pick = random.choice(len(windows), BATCH, p=share / share.sum())
        net.learn(padded[pick].T, labels[pick], valid[pick].T)
    return net.model(languages)


def sample_of(docs: DataFrame, id_column: str, text_column: str, label_column: str) -> list:
    """(text window, label) pairs: of each label at most SAMPLE_DOCS rows with a text, by a hash of id and text.

    Rows equal in id and text are one. Which rows these are depends on the rows alone.
    """
    text = F.col(text_column)
    mark = F.xxhash64(F.col(id_column), text, F.lit("sample"))
    start = F.pmod(mark, F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    named = docs.filter(F.col(label_column).isNotNull() & (F.coalesce(F.length(text), F.lit(0)) > 0)).select(
        F.col(label_column).alias("label"),
        mark.alias("mark"),
        F.substring(text, start, F.lit(SAMPLE_CHARS)).alias("text"),
    )
    # One row a label.
    counts = named.groupBy("label").agg(F.approx_count_distinct("mark").alias("n")).collect()
    few = F.lit(False)
    for label, n in sorted(map(tuple, counts)):
        few = few | ((F.col("label") == label) & hash_below(F.col("mark"), SAMPLE_DOCS, n))
    ranked = (
        named.filter(few)
        .dropDuplicates(["label", "mark"])
        .withColumn("place", F.row_number().over(W.partitionBy("label").orderBy("mark")))
    )
    # At most SAMPLE_DOCS windows a label.
    picked = ranked.filter(F.col("place") <= SAMPLE_DOCS).select("label", "place", "text").collect()
    return [(r.text, r.label) for r in sorted(picked, key=lambda r: (r.label, r.place))]


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang"
) -> Model | None:
    """A model of the labelled rows; give it only those it may learn from."""
    return train(sample_of(docs, id_column, text_column, label_column))


def _predict(model: Model | None, text_column: str) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_column):
            known = np.asarray(batch.column("_letters"))
            labels, scores = [UNDETERMINED] * len(known), np.zeros(len(known))
            if model is not None and known.any():
                found = pooled(model, *text_bytes(batch.column(text_column)))
                best = found.argmax(1)
                for i in np.flatnonzero(known):
                    labels[i], scores[i] = model.languages[best[i]], min(1.0, found[i, best[i]])
            names = [n for n in batch.schema.names if n != "_letters"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(labels), pa.array(scores)],
                [*names, "lang_pred", "score"],
            )

    return predict


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, which replace columns of these names."""
    ship_code(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "_letters")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.withColumn("_letters", has_letter(F.col(text_column))).mapInArrow(
        _predict(model, text_column), ", ".join([*kinds, "lang_pred string", "score double"])
    )
