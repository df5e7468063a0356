"""Word shingles of many texts at once, as arrays of 64-bit hashes.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, with A to Z made
lower case. A shingle is a run of five words; a text of fewer words has its whole word
sequence as its one shingle, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes hashed at a time; bounds the working arrays.
PIECE = 1 << 18
U64 = np.uint64

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACES] = 0
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_WORD_AT = _random.integers(1, 2**63, SHINGLE_WORDS, dtype=U64) * U64(2) + U64(1)
_SHORT = _random.integers(1, 2**63, SHINGLE_WORDS + 1, dtype=U64)


def _powers(base: int) -> np.ndarray:
    steps = np.full(PIECE + 1, base, U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWER, _UNPOWER = _powers(_STEP), _powers(_BACK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and where each row starts in them.

    Row i is ``bytes[starts[i]:starts[i + 1]]``; nulls are empty.
    """
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    starts = np.frombuffer(ends, np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, or of one longer text.

    Working arrays take many times the room of the text they describe.
    """
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        starts = text_bytes(batch.column(column))[1]
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(starts, starts[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def word_places(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words do not reach over the start of a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACES[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~solid[:-1]
    fresh[starts] = True
    first = np.flatnonzero(solid & fresh[:-1])
    gap = np.ones(len(data), bool)
    gap[:-1] = ~solid[1:]
    gap |= fresh[1:] & solid
    last = np.flatnonzero(solid & gap)
    return first, last + 1


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over pieces of the bytes.

    A word within one piece costs two lookups; one that reaches over pieces adds up
    its parts, scaled by their distance from its start.
    """
    out = np.zeros(len(first), U64)
    for low in range(0, len(data), PIECE):
        part = data[low : low + PIECE]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=sums[1:])
        a, b = np.searchsorted(end, low, "right"), np.searchsorted(first, low + len(part))
        begin = first[a:b]
        left = np.maximum(begin, low) - low
        right = np.minimum(end[a:b], low + len(part)) - low
        value = (sums[right] - sums[left]) * _UNPOWER[left]
        for k in np.flatnonzero(begin < low):
            value[k : k + 1] *= U64(pow(_STEP, int(low - begin[k]), 1 << 64))
        out[a:b] += value
    return mixed(out)


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of rows with ``counts`` words each, and the number of each row's."""
    if not len(words):
        return np.zeros(0, U64), np.zeros(len(counts), np.int64)
    n = SHINGLE_WORDS
    ends = np.cumsum(counts)
    padded = np.concatenate([words, np.zeros(n - 1, U64)])
    total = np.zeros(len(words), U64)
    for k in range(n):
        total += padded[k : k + len(words)] * _WORD_AT[k]
    use = np.ones(len(words), bool)
    for k in range(1, n):  # the last places of a long row start no shingle
        at = ends[counts >= n] - k
        use[at] = False
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        low, size = ends[row] - counts[row], counts[row]
        whole = (words[low : low + size] * _WORD_AT[:size]).sum(dtype=U64, keepdims=True)
        total[low : low + 1] = whole + _SHORT[size]
        use[low + 1 : low + size] = False
    return mixed(total[use]), np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))


def shingles_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order, and where each row's start."""
    data, starts = text_bytes(column)
    first, end = word_places(data, starts)
    at = np.searchsorted(first, starts)
    found, sizes = shingle_hashes(word_hashes(data, first, end), np.diff(at))
    return found, np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    found, at = shingles_of(column)
    for low, high in zip(at[:-1], at[1:]):
        values = np.sort(found[low:high])
        if len(values) > 1:
            values = values[np.concatenate([[True], values[1:] != values[:-1]])]
        yield values
