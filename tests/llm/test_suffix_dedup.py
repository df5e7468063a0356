from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from monthweave.llm import bwt, suffix_dedup
from tests.llm.cases import TEXTS, messy, nothing


def covered(texts, length):
    """Spans and kept bytes of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        edges = [i for i in range(len(b) + 1) if (i and mark[i - 1]) != (i < len(b) and mark[i])]
        spans = list(zip(edges[::2], edges[1::2]))
        out.append((spans, bytes(x for x, m in zip(b, mark) if not m)))
    return out


def test_transform_against_counting():
    rnd = random.Random(2)
    for _ in range(600):
        length = rnd.choice([1, 2, 3, 5, 9, 20])
        base = bytes(rnd.choice(b"ab\x00c") for _ in range(60))
        strings = []
        for _ in range(rnd.randrange(1, 9)):
            a = rnd.randrange(60)
            s = bytearray(base[a : rnd.randrange(a, 61)])
            for _ in range(rnd.randrange(3)):
                if s:
                    s[rnd.randrange(len(s))] = rnd.choice(b"ab\x00")
            strings.append(bytes(s))
        times = np.array([rnd.choice([1, 1, 1, 2]) for _ in strings])
        count = Counter()
        for s, t in zip(strings, times):
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] += t
        want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1}
        found = bwt.repeated_windows(strings, times, length)
        assert {(k, i) for k, a, b in zip(*found) for i in range(a, b)} == want


def check(spark, rows, length):
    found = suffix_dedup.remove_repeats(messy(spark, rows), length).collect()
    want = Counter((i, tuple(s), k) for (i, _), (s, k) in zip(rows, covered([t for _, t in rows], length)))
    assert Counter((r.id, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in found) == want


def passages():
    rnd = random.Random(4)
    base = "".join(rnd.choice("abé\x00d ") for _ in range(400))
    noise = lambda: "".join(rnd.choice("xyz") for _ in range(rnd.randrange(9)))
    texts = [None, ""]
    for _ in range(150):
        a = rnd.randrange(300)
        part = base[a : a + rnd.randrange(5, 90)]
        texts.append(noise() + part + noise() + rnd.choice(["", part]))
    return list(enumerate(texts))


@pytest.mark.parametrize("length", [12, 30])
def test_passages(spark, length):
    check(spark, passages(), length)


@pytest.mark.parametrize("length, windows", [(12, 16), (30, 4)])
def test_large_groups_are_divided(spark, monkeypatch, length, windows):
    monkeypatch.setattr(suffix_dedup, "GROUP_STRINGS", 2)
    monkeypatch.setattr(suffix_dedup, "PIECE_WINDOWS", windows)
    check(spark, passages(), length)


def test_messy_rows(spark):
    check(spark, [(i, t[:3000] if t else t) for i, t in TEXTS], 200)
    assert suffix_dedup.remove_repeats(nothing(spark)).count() == 0


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN", 64)
    rnd = np.random.default_rng(1)
    data, starts = rnd.integers(97, 99, 700).astype(np.uint8), np.array([0, 0, 5, 300, 310, 700])
    row, first, runs, place, hashes = suffix_dedup.anchor_runs(data, starts, 20, 8)
    seen = Counter((r, w) for r, f, n in zip(row, first, runs) for w in range(f, f + n))
    sizes = np.diff(starts)
    assert seen == Counter((r, w) for r in range(5) for w in range(max(0, sizes[r] - 19)))
    assert (place >= runs - 1).all() and (place <= 12).all()


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(nothing(spark), 300)
