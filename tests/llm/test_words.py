from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from monthweave.llm import words
from tests.llm.cases import LONG, TEXTS, shingles


def test_sets_are_those_of_the_words():
    rnd = random.Random(1)
    texts = [t for _, t in TEXTS] + ["x" * 600_000 + " y z w v u " + "é" * 200_000, LONG * 3]
    texts += ["".join(rnd.choice("aAbB é\n\t\x0b\x85\xa0") for _ in range(rnd.randrange(60))) for _ in range(2000)]
    found = list(words.shingle_sets(pa.array(texts, pa.string())))
    named: dict[frozenset, set] = {}
    for text, hashes in zip(texts, found):
        assert len(hashes) == len(shingles(text))
        assert (np.diff(hashes.astype(object)) > 0).all()
        named.setdefault(shingles(text), set()).add(tuple(hashes))
    assert all(len(v) == 1 for v in named.values())
    assert len({next(iter(v)) for v in named.values()}) == len(named)


def test_slices_and_small_batches():
    column = pa.array(["a b c d e f", None, "", "g" * 100, "a b c d e f"])
    whole = [list(s) for s in words.shingle_sets(column)]
    assert [list(s) for s in words.shingle_sets(column.slice(3))] == whole[3:]
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    parts = list(words.small_batches(iter([batch]), limit=8))
    assert len(parts) > 2
    assert [t for p in parts for t in p.column("text").to_pylist()] == column.to_pylist()
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])
    assert [b.num_rows for b in words.small_batches(iter([empty]))] == [0]
    assert list(words.shingle_sets(empty.column("text"))) == []
