from __future__ import annotations

import random
import time

import pytest

from monthweave.llm import components
from monthweave.llm.components import connected_components
from monthweave.llm.near_dedup import near_duplicates
from tests.llm.cases import TEXTS, changed, messy, nothing, random_text, shingles


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    chain = [(i, i + 1) for i in range(40)] + [(i + 1, i) for i in range(20)]
    star = [(60, 60 + i) for i in range(1, 30)] + [(7, 7)]
    loose = [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    links = chain + star + loose
    rnd.shuffle(links)
    found = connected_components(spark.createDataFrame(links + [(None, 3)], "a long, b long"))
    want = roots(200, links)
    linked = {x for a, b in links for x in (a, b) if a != b}
    assert {(r.node, r.component) for r in found.collect()} == {(x, want[x]) for x in linked}
    assert found.count() == len(linked)


def test_shuffles_do_not_pile_up_with_the_steps(spark, monkeypatch):
    """After each step the shuffle files of the earlier ones go, however long the chain."""
    statuses = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    held = lambda: set(statuses.keySet().mkString(" ").split())
    own = held()
    plain, seen, stale = components._state, [], []

    def watched(edges):
        # Spark's cleaner works beside the job.
        end = time.time() + 3
        while len(seen) > 3 and held() & seen[-3] and time.time() < end:
            time.sleep(0.1)
        stale.append(held() & seen[-3] if len(seen) > 3 else set())
        seen.append(held() - own)
        return plain(edges)

    monkeypatch.setattr(components, "_state", watched)
    order = list(range(600))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.component for r in connected_components(links).collect()} == {0}
    assert len(seen) > 6 and not any(stale), stale


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    root = roots(len(rows), links)
    least: dict[int, list] = {}
    for r, (i, _) in zip(root, rows):
        least.setdefault(r, []).append((i is None, i))
    ids = {r: min(v)[1] for r, v in least.items()}
    return sorted(((i, len(s), ids[r]) for (i, _), s, r in zip(rows, sets, root)), key=repr)


def found(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_messy_rows(spark):
    df = near_duplicates(messy(spark))
    assert found(df) == expected(TEXTS)
    rows = df.collect()
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    # One row of each component stays; those without words are alone.
    classes = {}
    for r in rows:
        if r.n_shingles:
            classes.setdefault(r.component_id, []).append(r.stays)
        else:
            assert r.stays
    assert all(sum(v) == 1 for k, v in classes.items())
    assert near_duplicates(nothing(spark)).count() == 0


def test_against_all_pairs(spark):
    """Copies, near copies around the threshold, chains and texts that only share passages."""
    rnd = random.Random(9)
    texts = []
    for _ in range(12):
        base = random_text(rnd, rnd.randrange(6, 120), 10**6)
        texts += [base] * rnd.randrange(1, 4)
        for _ in range(rnd.randrange(6)):
            base = changed(rnd, base, rnd.randrange(0, 3)) if rnd.random() < 0.5 else base
            texts.append(changed(rnd, base, rnd.randrange(0, 5)))
    half = random_text(rnd, 60, 10**6)
    texts += [half + " " + random_text(rnd, 30, 10**6) for _ in range(25)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    assert found(near_duplicates(messy(spark, rows))) == expected(rows)


def test_hot_group_of_near_copies(spark):
    """Copies that reach each other only over others, in buckets larger than one round's centers."""
    rnd = random.Random(3)
    base = random_text(rnd, 200, 10**6)
    rows = [(i, changed(rnd, base, rnd.randrange(0, 7))) for i in range(150)]
    assert found(near_duplicates(messy(spark, rows))) == expected(rows)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("monthweave.llm.near_dedup.BLOCK_NODES", 4)
    rnd = random.Random(8)
    base = random_text(rnd, 80, 10**6)
    rows = [(i, changed(rnd, base, rnd.randrange(0, 6))) for i in range(60)]
    other = changed(rnd, base, 8)
    rows += [(100 + i, changed(rnd, other, rnd.randrange(0, 4))) for i in range(30)]
    assert found(near_duplicates(messy(spark, rows))) == expected(rows)
