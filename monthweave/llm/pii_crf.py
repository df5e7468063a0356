"""Personal data by fixed patterns and a linear-chain conditional random field.

Patterns find emails, IP addresses, card and phone numbers. The field reads a text's words line by line,
describes each by its shape (character classes, counts of digits and dots, length, first and last
character, digits of the neighbours), and its Viterbi path adds runs of words that it takes for
personal data; words that touch a pattern match are cut out of them. It is trained in numpy on a small labelled table: windows of
words around the digits and at signs of at most ``SAMPLE_DOCS`` documents, at most ``DOC_WINDOWS`` of each
at even distances, labelled by the patterns. The windows are cut in the tasks; no text goes to the driver.

All offsets are code points, the end exclusive. A line is one chain, however long; decoding
keeps five bytes a word of a batch to go back by.

Cases: a null text counts as empty and has no spans. Spans of different kinds may
overlap. Repeated rows are searched each and null ids carried along. Without any labelled
word only the patterns count. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, hash_below, ship_code, with_row
from monthweave.llm.words import small_batches, text_bytes, word_places

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_DOCS = 600
SAMPLE_POOL = 30_000
DOC_WINDOWS = 64
WINDOW_WORDS = 6
STEPS = 120
RATE = 0.15
DECAY = 1e-4

# Fixed patterns of the four kinds. The look-behind of the second and third changes no
# match: a match from within a run of digits would also start at the run's start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[@0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, an at sign and a dotted domain, leftmost first.

    The local part is the run of its characters that ends at the sign, cut at the last
    match; looking back from each sign keeps long runs without a sign cheap.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def _is_ip(match: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in match.split(".")))


def _is_card(match: str) -> bool:
    digits = [ord(c) - 48 for c in match if c.isdigit()]
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _is_phone(match: str) -> bool:
    return 10 <= sum(c.isdigit() for c in match) <= 15


def pattern_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by start, then by kind as listed."""
    if not text or not _HINT.search(text):
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, right in (
        ("ip", _IP, _is_ip),
        ("card", _CARD, _is_card),
        ("phone", _PHONE, _is_phone),
    ):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if right(m.group())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- word shapes ----------------------------------------------------------------

_CLASS = np.full(256, 8, np.uint8)  # other printable
for _place, _chars in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"@", b".", b"-", b"+", b"()")
):
    _CLASS[list(_chars)] = _place
_CLASS[128:] = 9
_BITS = (1 << _CLASS.astype(np.uint16)).astype(np.uint16)
_BITS[[0x20, *range(0x09, 0x0E)]] = 0
_DIGIT = (_CLASS == 2).astype(np.int32)
_DOT = (_CLASS == 4).astype(np.int32)
#: Upper ends of the buckets for counts of digits, dots and characters.
_DIGIT_ENDS = np.array([0, 1, 2, 3, 4, 6, 9, 13, 19])
_LENGTH_ENDS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24])
#: Values of each feature; the last one of the neighbour features stands for none.
SIZES = (1024, 10 * 5, 10 * 10, 10 * 10, 41, 41)
#: The first feature is a set of classes, whose weights add up, so that new sets get a score too.
_MEMBERS = (np.arange(SIZES[0])[:, None] >> np.arange(10) & 1).astype(np.float64)


@dataclass(frozen=True)
class Shapes:
    """Words of many texts: places in the bytes, features, and where lines begin."""

    first: np.ndarray
    end: np.ndarray
    features: np.ndarray  # len(SIZES) x words
    line_starts: np.ndarray  # places in the words, and their number at the end


def shapes(data: np.ndarray, starts: np.ndarray) -> Shapes:
    first, end = word_places(data, starts)
    n = len(first)
    if not n:
        return Shapes(first, end, np.zeros((len(SIZES), 0), np.int64), np.zeros(1, np.int64))
    bits = np.bitwise_or.reduceat(_BITS[data], first)
    digits = np.add.reduceat(_DIGIT[data], first)
    dots = np.add.reduceat(_DOT[data], first)
    digit = np.searchsorted(_DIGIT_ENDS, digits)
    size = np.searchsorted(_LENGTH_ENDS, end - first)
    beside = digit + 10 * ((bits >> 6) & 3)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[starts] = True
    breaks[1:][(data == 10) | (data == 13)] = True
    count = np.cumsum(breaks)
    line = count[first]
    fresh = np.ones(n, bool)
    fresh[1:] = line[1:] != line[:-1]
    before, after = np.full(n, 40), np.full(n, 40)
    before[1:] = np.where(fresh[1:], 40, beside[:-1])
    after[:-1] = np.where(fresh[1:], 40, beside[1:])
    features = np.stack(
        [
            bits,
            digit * 5 + np.minimum(dots, 4),
            size * 10 + digit,
            _CLASS[data[first]].astype(np.int64) * 10 + _CLASS[data[end - 1]],
            before,
            after,
        ]
    )
    return Shapes(first, end, features.astype(np.int64), np.append(np.flatnonzero(fresh), n))


# ---- the field ----------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Weights of each feature value and label, of label pairs, and of first labels."""

    emit: tuple[np.ndarray, ...]
    step: np.ndarray
    begin: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = self.emit[0].take(features[0], 0)
        for weights, values in zip(self.emit[1:], features[1:]):
            total += weights.take(values, 0)
        return total


def viterbi(field: Field, words: Shapes) -> np.ndarray:
    """The best label of every word; lines are decoded side by side, the longest first."""
    k = len(LABELS)
    labels = np.zeros(words.features.shape[1], np.int8)
    if not len(labels):
        return labels
    scores = field.scores(words.features)
    sizes = np.diff(words.line_starts)
    order = np.argsort(-sizes, kind="stable")
    low, sizes = words.line_starts[:-1][order], sizes[order]
    reach = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # lines of step t or more
    best = scores[low] + field.begin
    # Labels before the best ones, of the lines of each step one after the other.
    back = np.empty((len(labels), k), np.int8)
    place = np.concatenate([[0], np.cumsum(reach)])
    last = np.zeros((len(low), k), np.float32)
    for t in range(1, len(reach) + 1):
        n = reach[t] if t < len(reach) else 0
        last[n : len(best)] = best[n:]
        if not n:
            break
        steps = best[:n, :, None] + field.step
        came = steps.argmax(1).astype(np.int8)
        best = np.take_along_axis(steps, came[:, None, :].astype(np.intp), 1)[:, 0] + scores[low[:n] + t]
        back[place[t] : place[t + 1]] = came
    now = last.argmax(1).astype(np.int8)
    for t in range(len(reach) - 1, -1, -1):
        n = reach[t]
        labels[low[:n] + t] = now[:n]
        if t:
            came = back[place[t] : place[t + 1]]
            now[:n] = np.take_along_axis(came, now[:n, None].astype(np.intp), 1)[:, 0]
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(features: np.ndarray, labels: np.ndarray, valid: np.ndarray) -> Field:
    """Maximum likelihood with decay on windows: features kinds x windows x words.

    The gradient is the observed counts less the expected ones of forward and backward sums.
    """
    k, (n, width) = len(LABELS), labels.shape
    weights = [np.zeros((s, k)) for s in (10, *SIZES[1:])] + [np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    one = np.eye(k)[labels] * valid[:, :, None]
    pairs = valid[:, 1:] & valid[:, :-1]
    seen_step = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:] * pairs[:, :, None])
    for step_no in range(1, STEPS + 1):
        classes, *emit, step, begin = weights
        emit = [_MEMBERS @ classes, *emit]
        score = sum(w[f] for w, f in zip(emit, features))
        alpha, beta = np.empty((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = score[:, 0] + begin
        for t in range(1, width):
            moved = _log_sum(alpha[:, t - 1, :, None] + step, 1) + score[:, t]
            alpha[:, t] = np.where(valid[:, t, None], moved, alpha[:, t - 1])
        whole = _log_sum(alpha[:, -1], 1)[:, None]
        expected_step = np.zeros((k, k))
        for t in range(width - 2, -1, -1):
            ahead = step + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(valid[:, t + 1, None], _log_sum(ahead, 2), beta[:, t + 1])
            both = np.exp(alpha[:, t, :, None] + ahead - whole[:, :, None])
            expected_step += both[valid[:, t + 1]].sum(0)
        chance = np.exp(alpha + beta - whole[:, :, None]) * valid[:, :, None]
        miss = one - chance
        grads = []
        for values, size in zip(features, SIZES):
            g = np.zeros((size, k))
            np.add.at(g, values.ravel(), miss.reshape(-1, k))
            grads.append(g)
        grads[0] = _MEMBERS.T @ grads[0]
        grads += [seen_step - expected_step, miss[:, 0].sum(0)]
        for w, g, m, v in zip(weights, grads, first, second):
            g = g / n - DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step_no)) / (np.sqrt(v / (1 - 0.99**step_no)) + 1e-8)
    weights[0] = _MEMBERS @ weights[0]
    *emit, step, begin = (w.astype(np.float32) for w in weights)
    return Field(tuple(emit), step, begin)


def _in_bytes(text: str, spans: list[Span]) -> list[Span]:
    return [(k, len(text[:a].encode()), len(text[:b].encode())) for k, a, b in spans]


def _windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of at most DOC_WINDOWS windows around digits and at signs, at even distances."""
    width = 2 * WINDOW_WORDS + 1
    data = np.frombuffer(text.encode(), np.uint8)
    words = shapes(data, np.array([0, len(data)]))
    labels = np.zeros(len(words.first), np.int64)
    for kind, low, high in _in_bytes(text, pattern_spans(text)):
        a = np.searchsorted(words.end, low, "right")
        b = np.searchsorted(words.first, high)
        labels[a:b] = LABELS.index(kind)
    odd = np.flatnonzero((words.features[0] & 0b1100) > 0)
    places, done = [], -1
    for i in odd.tolist():
        if i <= done:
            continue
        line = np.searchsorted(words.line_starts, i, "right")
        low = max(i - WINDOW_WORDS, words.line_starts[line - 1])
        high = min(low + width, words.line_starts[line])
        done = high - WINDOW_WORDS
        places.append((low, high))
    some = np.unique(np.linspace(0, len(places) - 1, min(DOC_WINDOWS, len(places))).astype(int))
    return [(words.features[:, a:b], labels[a:b]) for a, b in (places[j] for j in some)]


def labelled_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, labels and validity of the windows of all texts."""
    return _stacked([w for text in texts for w in _windows(text)])


def _stacked(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    if not any(labels.any() for _, labels in windows):
        return None
    width = 2 * WINDOW_WORDS + 1
    room = [width - len(labels) for _, labels in windows]
    return (
        np.stack([np.pad(f, ((0, 0), (0, r))) for (f, _), r in zip(windows, room)], 1),
        np.stack([np.pad(labels, (0, r)) for (_, labels), r in zip(windows, room)]),
        np.stack([np.arange(width) < width - r for r in room]),
    )


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the sampled texts: the row's mark, a number, and features and labels in one list."""
    for batch in small_batches(batches):
        rows = [
            (mark.as_py(), k, np.vstack([features, labels[None]]).ravel().tolist())
            for mark, text in zip(batch.column("mark"), batch.column("text"))
            for k, (features, labels) in enumerate(_windows(text.as_py()))
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            ],
            ["mark", "k", "cells"],
        )


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Field | None:
    """A field from at most SAMPLE_DOCS documents with an at sign or a longer number, by a hash of
    id and text, out of SAMPLE_POOL documents or so.

    Rows equal in id and text are one. Which rows these are depends on the rows alone.
    """
    ship_code(docs.sparkSession)
    mark = F.xxhash64(F.col(id_column), F.col(text_column), F.lit("labelled"))
    some = docs.select(mark.alias("mark"), F.col(text_column).alias("text")).filter(
        hash_below(F.col("mark"), SAMPLE_POOL, docs.count()) & F.col("text").rlike("@|[0-9][0-9.() -]*[0-9]")
    )
    picked = some.select("mark").distinct().orderBy("mark").limit(SAMPLE_DOCS)
    # At most SAMPLE_DOCS x DOC_WINDOWS different windows.
    found = (
        some.join(F.broadcast(picked), "mark")
        .mapInArrow(_cut_windows, "mark long, k int, cells array<long>")
        .dropDuplicates(["mark", "k"])
        .collect()
    )
    cells = [
        np.array(r.cells, np.int64).reshape(len(SIZES) + 1, -1) for r in sorted(found, key=lambda r: (r.mark, r.k))
    ]
    windows = _stacked([(c[:-1], c[-1]) for c in cells])
    return None if windows is None else train(*windows)


def trimmed(data: np.ndarray | bytes, low: int, high: int) -> tuple[int, int]:
    """Outer punctuation is no part of the data."""
    while low < high and _CLASS[data[low]] in (3, 4, 5, 7, 8) and data[low] != 0x28:
        low += 1
    while low < high and _CLASS[data[high - 1]] in (3, 4, 5, 6, 7, 8):
        high -= 1
    return low, high


def added_spans(field: Field, data: np.ndarray, starts: np.ndarray) -> dict[int, list[Span]]:
    """Runs of words with one label, by row, in bytes from the row's start."""
    words = shapes(data, starts)
    labels = viterbi(field, words)
    hit = np.flatnonzero(labels)
    found: dict[int, list[Span]] = {}
    if not len(hit):
        return found
    fresh = np.zeros(len(labels) + 1, bool)
    fresh[words.line_starts] = True
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (labels[hit[1:]] != labels[hit[:-1]]) | fresh[hit[1:]]
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], len(hit)) - 1
    for a, b in zip(hit[begins].tolist(), hit[stops].tolist()):
        low, high = trimmed(data, int(words.first[a]), int(words.end[b]))
        if low < high:
            row = int(np.searchsorted(starts, low, "right")) - 1
            found.setdefault(row, []).append((LABELS[labels[a]], low - int(starts[row]), high - int(starts[row])))
    return found


def beside(text: str, low: int, high: int, found: list[Span]) -> list[tuple[int, int]]:
    """The parts of a run of words without those that touch a span of ``found``."""
    near = [(x, y) for _, x, y in found if x < high and low < y]
    if not near:
        return [(low, high)]
    parts = [[]]
    for word in _WORD.finditer(text, low, high):
        a, b = word.span()
        if any(x < b and a < y for x, y in near):
            parts.append([])
            continue
        raw = word.group().encode()
        first, end = trimmed(raw, 0, len(raw))
        if first < end:  # punctuation alone neither begins nor ends a part
            begin = a + len(raw[:first].decode())
            parts[-1].append((begin, begin + len(raw[first:end].decode())))
    return [(part[0][0], part[-1][1]) for part in parts if part]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _search(field: Field | None) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            column = batch.column("text")
            added = {} if field is None else added_spans(field, *text_bytes(column))
            base, spans = [], []
            for i, cell in enumerate(column):
                text = cell.as_py()
                found = pattern_spans(text)
                both = list(found)
                if i in added:
                    raw = text.encode()
                    for kind, low, high in added[i]:
                        a = len(raw[:low].decode(errors="ignore"))
                        b = a + len(raw[low:high].decode(errors="ignore"))
                        both += [(kind, x, y) for x, y in beside(text, a, b, found)]
                    both.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                base.append([{"kind": k, "start": a, "stop": b} for k, a, b in found])
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in both])
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("id"), pa.array(base, _SPANS), pa.array(spans, _SPANS)],
                [ROW, "id", "base", "spans"],
            )

    return search


def find_personal_data(
    docs: DataFrame, field: Field | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns _row (place in ``docs``), id, base (spans of the patterns), spans (all)."""
    kinds = "array<struct<kind: string, start: long, stop: long>>"
    return (
        with_row(docs)
        .select(ROW, F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(_search(field), f"{ROW} long, id long, base {kinds}, spans {kinds}")
    )
