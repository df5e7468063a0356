"""Runs of words that repeat with a period, found in whole texts by multi-scale minimizers.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. A run is a stretch of
consecutive words with smallest period q (words q apart are equal) of at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words that no neighbouring word extends.

Periods up to SHORT are found by scanning the words directly at each such lag. Longer
periods are divided into scales. A scale (low, high] looks at stretches of ``high`` words
and at windows of ``2 * low + 3 - high`` consecutive stretches, and keeps the stretches with
the least hash of some window. Why no run is missed: let a run of smallest period q, low < q
<= high, have 3q words or more. Windows q apart in it hold the same stretches, so a kept stretch
is kept again q words on; there is room for both, since the words of a window and a period
are at most 3q. No equal stretch lies between the two, since a stretch is no shorter than
the period and a shorter shift of it onto itself would be a smaller period. So the two are
neighbours among the equal stretches, and all pairs of neighbours at a distance within the scale are
extended to both sides, word by word. Extension is exact; hashes only choose
where it begins. Equal stretches have equal hashes; two unlike stretches with one 64-bit
hash could hide a run of a period beyond SHORT, with a chance below 1e-7 a batch of texts.

A found stretch with period d also has every smaller period that it has, and then as the same
stretch; the smallest found is kept.

Each text is treated within one task, texts in small batches; working memory is some
dozens of bytes a word, whatever the periods. A very long text is a batch of its own.

Cases: a null, empty or blank text has no words and no runs, and collapses to an empty text.
Repeated rows and null ids are carried along, each with its result. Other columns are
ignored, whatever their names. An empty table gives no rows. Runs that tie in all things do not exist:
two runs differ in start or period.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.llm.storage import ship_code
from monthweave.llm.words import U64, mixed, small_batches

MIN_WORDS = 24
MIN_PERIODS = 3
#: Periods up to this one are scanned for directly.
SHORT = 16
#: Words compared at first when a pair is extended; the number doubles while they are equal.
STEP = 64
#: Bytes of text that are treated at a time.
BATCH_BYTES = 1 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """Period ranges (low, high] above SHORT that cover all periods up to ``longest``."""
    low = SHORT
    while low < longest:
        high = low + low // 2
        yield low, high
        low = high


def equal_ahead(words: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, a < b."""
    done, step = 0, STEP
    while True:
        right = words[b + done : b + done + step]
        unlike = np.flatnonzero(words[a + done : a + done + len(right)] != right)
        if len(unlike):
            return done + int(unlike[0])
        done += len(right)
        if len(right) < step:
            return done
        step *= 2


def equal_behind(words: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` equal those before ``b``, a < b."""
    done, step = 0, STEP
    while True:
        left = words[max(a - done - step, 0) : a - done]
        unlike = np.flatnonzero(words[b - done - len(left) : b - done] != left)
        if len(unlike):
            return done + len(left) - 1 - int(unlike[-1])
        done += len(left)
        if len(left) < step:
            return done
        step *= 2


def least(words: int, period: int) -> bool:
    return words >= max(MIN_WORDS, MIN_PERIODS * period)


def short_runs(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and lag of all stretches with a lag up to SHORT."""
    for lag in range(1, min(SHORT, len(words) // MIN_PERIODS) + 1):
        same = np.zeros(len(words) - lag + 2, np.int8)
        same[1:-1] = words[lag:] == words[:-lag]
        turns = np.flatnonzero(np.diff(same))
        starts, stops = turns[::2], turns[1::2]
        long = stops - starts + lag >= max(MIN_WORDS, MIN_PERIODS * lag)
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            yield start, stop + lag, lag


def window_least(values: np.ndarray, size: int, least=np.minimum) -> np.ndarray:
    """The least value of every window of ``size`` neighbours."""
    span = 1
    while span * 2 <= size:
        values = least(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return least(values[:-rest], values[rest:]) if rest else values


def kept_by_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The places whose value is the least of some window of ``size`` places around it."""
    minima = window_least(values, size)
    around = np.zeros(len(minima) + 2 * (size - 1), U64)
    around[size - 1 : size - 1 + len(minima)] = minima
    return np.flatnonzero(window_least(around, size, np.maximum) == values)


def equal_neighbours(values: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of kept places with one value and no such place between them."""
    order = kept[np.argsort(values[kept], kind="stable")]
    same = values[order[1:]] == values[order[:-1]]
    return order[:-1][same], order[1:][same]


def long_runs(words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and lag of all stretches with a lag above SHORT.

    ``sizes`` are the words of each text, the largest first; texts too short for a scale
    are left out of it.
    """
    ends = np.cumsum(sizes)
    hashes, span = mixed(words.astype(U64) * _LEFT + _RIGHT), 1
    for low, high in scales(int(sizes[0]) // MIN_PERIODS if len(sizes) else 0):
        texts = int(np.searchsorted(-sizes, -MIN_PERIODS * (low + 1), "right"))
        size = int(ends[texts - 1])
        while span * 2 <= high:
            hashes = mixed(hashes[:-span] * _LEFT + mixed(hashes[span:] ^ _RIGHT))
            span *= 2
        # Stretches of ``high`` words, each put together from two that overlap.
        more = high - span
        use = hashes[: size - span + 1]
        values = mixed(use[: len(use) - more] * _RIGHT + mixed(use[more:] ^ _LEFT)) if more else use
        window = 2 * low + 3 - high
        if len(values) < window:
            continue
        first, second = equal_neighbours(values, kept_by_windows(values, window))
        lags = second - first
        fits = (lags > low) & (lags <= high)
        first, lags = first[fits], lags[fits]
        order = np.lexsort((first, lags))
        first, lags = first[order], lags[order]
        # Pairs of one lag lie together; those within a stretch already extended are passed over.
        done = (0, 0)
        for start, lag in zip(first.tolist(), lags.tolist()):
            if lag == done[0] and start < done[1]:
                continue
            ahead = equal_ahead(words, start, start + lag)
            behind = equal_behind(words, start, start + lag)
            done = (lag, start + ahead)
            if least(ahead + behind + lag, lag):
                yield start - behind, start + ahead + lag, lag


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period.

    The texts lie in one array, the longest first, with a word of its own behind each, which no
    period can reach over.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    parts = []
    for i in order:
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in texts[i]] + [-1], np.int64))
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    words[ends - 1] = len(numbers) + np.arange(len(parts))
    found: dict[tuple[int, int], int] = {}
    for start, end, period in (*short_runs(words), *long_runs(words, sizes)):
        found[start, end] = min(period, found.get((start, end), period))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = ends - sizes
    for (start, end), period in found.items():
        at = int(np.searchsorted(ends, start, "right"))
        runs[order[at]].append((start - int(begins[at]), end - start, period))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in runs]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those behind the first period of a run."""
    kept, done = [], 0
    for low, high in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[done:low]
        done = max(done, high)
    return b" ".join(kept + words[done:])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, limit=BATCH_BYTES):
        column = batch.column("text").cast(pa.binary())
        texts = [_WORD.findall(t.as_py() or b"") for t in column]
        runs = runs_of(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(map(len, texts), pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(RUN)),
                pa.array([collapsed(t, r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string()),
            ],
            ["id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, n_words, runs (array of start, length, period) and collapsed (the text without
    the words that only repeat a period).

    Starts and lengths count words from 0; runs are in the order of start, then period. One row
    for each row of ``docs``; nothing is shuffled.
    """
    ship_code(docs.sparkSession)
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(
        _find,
        f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )
