"""Which long substrings of some byte strings occur again, from a Burrows-Wheeler transform.

Intervals of the suffix array are expanded breadth first: from the interval of a string w,
backward extension finds those of all cw. The right border of an interval that is found first
for strings of length l + 1 separates suffixes with l symbols in common, so common prefix
lengths come out in increasing order, and the search stops at the wanted length:
borders not found by then lie between suffixes that have at least that much in common.
"""

from __future__ import annotations

import numpy as np

#: Ends a string in the block; stands for no byte of a text.
STOP = 0
#: In place of the zero byte; no byte of UTF-8.
ZERO = 0xFF


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One block with a stop after each string, and where each begins."""
    sizes = np.array([len(s) for s in strings], np.int64) + 1
    raw = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).copy()
    begins = np.concatenate([[0], np.cumsum(sizes)])
    raw[raw == 0] = ZERO
    raw[begins[1:] - 1] = STOP
    return raw, begins


def sorted_suffixes(block: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by doubling."""
    n = len(block)
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel()
    key = key.astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    have = 8
    while have < depth:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        some = order[places]
        ahead = rank[np.minimum(some + have, n)]
        pair = rank[some] * (n + 2) + ahead + 1
        turn = np.argsort(pair)
        some, pair = some[turn], pair[turn]
        order[places] = some
        fresh = np.ones(len(places), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[places] = fresh
        rank[some] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        have *= 2
    return order


def borders_below(block: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it has less than ``length`` symbols in common with the
    one before; strings with a stop before their end are not followed."""
    n = len(block)
    before = block[order - 1]  # the transform
    by_symbol = np.argsort(before, kind="stable")
    front = np.empty(n, np.int64)  # where a suffix with its preceding symbol stands
    front[by_symbol] = np.arange(n)
    grouped = before[by_symbol].astype(np.int64) << 40 | by_symbol
    following = np.full(n, n, np.int64)  # next place with the same symbol
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for common in range(length):
        width = high - low + 1
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        at += np.repeat(low, width)
        last = following[at] > np.repeat(high, width)
        if common:
            last &= before[at] != STOP
        origin = np.repeat(low, width)[last]
        at = at[last]
        right = front[at]
        fresh = ~found[right + 1]
        right, at, origin = right[fresh], at[fresh], origin[fresh]
        if not len(right):
            break
        left = np.searchsorted(grouped, before[at].astype(np.int64) << 40 | origin)
        found[right + 1] = True
        low, high = left, right
    return found[:n]


def repeated_windows(
    strings: list[bytes], times: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places where a substring of ``length`` begins that begins elsewhere too.

    String i counts ``times[i]`` times. Returns string numbers, first places and ends.
    """
    block, begins = joined(strings)
    order = sorted_suffixes(block, length)
    border = borders_below(block, order, length)
    owner = np.repeat(np.arange(len(strings)), np.diff(begins))
    whole = np.arange(len(block)) + length < begins[owner + 1]
    group = np.cumsum(border) - 1
    weight = np.where(whole, times[owner], 0)[order]
    often = np.bincount(group, weight)[group] >= 2
    hit = np.zeros(len(block) + 1, bool)
    hit[order[often]] = True
    hit[:-1] &= whole
    edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    if hit[0]:
        edge = np.concatenate([[0], edge])
    first, end = edge[::2], edge[1::2]
    return owner[first], first - begins[owner[first]], end - begins[owner[first]]
