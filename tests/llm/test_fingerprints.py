from __future__ import annotations

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from monthweave.llm import queries
from monthweave.llm.fingerprints import ATTEMPTS, likeness, with_fingerprint
from monthweave.llm.next_texts import with_next
from tests.llm.cases import TEXTS, changed, messy, nothing, random_text

FOLDER = "/root/testdata/sf0.001"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chained(*values):
    """Spark's xxhash64 of several values: each is hashed with the hash so far as its seed."""
    h = 42
    for kind, v in values:
        data = v.encode() if kind == "s" else struct.pack({"l": "<q", "i": "<i"}[kind], v)
        h = xxhash.xxh64_intdigest(data, h)
    return signed(h)


def by_definition(text, bin_bits=8, low_bits=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    hashes = [chained(("s", w)) for w in words]
    if not words:
        return ""
    runs = [hashes[i : i + 5] for i in range(len(hashes) - 4)] or [hashes]
    bins = {}
    for run in runs:
        h = chained(*(("l", x) for x in run))
        b = h >> (64 - bin_bits)
        bins[b] = min(h, bins.get(b, h))
    half, out = 1 << (bin_bits - 1), []
    for i in range(2 * half):
        looked = [i - half] + [chained(("i", i), ("i", j)) >> (64 - bin_bits) for j in range(ATTEMPTS)]
        full = [b for b in looked if b in bins]
        b = full[0] if full else min(bins, key=lambda b: (chained(("i", i), ("i", b + half)) >> bin_bits, b))
        out.append(format(bins[b] & ((1 << low_bits) - 1), f"0{low_bits // 4}x"))
    return "".join(out)


def edited(texts):
    """(id, text) rows with their edited text and the next text, descending ids, nulls last."""
    rows = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        m = len(text) // 2
        out.append((i, len(text), text[: len(text) - m] + after[:m], after))
    return out


@pytest.mark.parametrize("bin_bits, low_bits", [(8, 8), (3, 4), (6, 16)])
def test_fingerprints_are_those_of_the_definition(spark, bin_bits, low_bits):
    rnd = random.Random(2)
    rows = TEXTS + [(100 + n, random_text(rnd, n)) for n in (1, 4, 5, 6, 8, 20, 60, 200, 700, 3000)]
    found = with_fingerprint(messy(spark, rows), "text", "mark", bin_bits, low_bits).collect()
    assert sorted(((r.doc_id, r.mark) for r in found), key=repr) == sorted(
        ((i, by_definition(t, bin_bits, low_bits)) for i, t in rows), key=repr
    )
    assert {r.score for r in found} == {"y"} and {r.id for r in found} == {"x"}
    assert with_fingerprint(nothing(spark)).count() == 0


def test_likeness_estimates_the_share_of_common_shingles(spark):
    rnd = random.Random(7)
    rows = []
    for size in (6, 30, 200, 2000):
        for edits in (0, 1, size // 50, size // 20, size // 8, size):
            for _ in range(10):
                text = random_text(rnd, size, 10**6)
                rows.append((len(rows), text, changed(rnd, text, edits)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    marks = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb")
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    errors = []
    for r in marks.select("a", "b", "fa", "fb", likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        a, b = sets(r.a), sets(r.b)
        assert 0 <= r.near <= 1 and (r.a != r.b or (r.fa == r.fb and r.near == 1))
        errors.append(r.near - len(a & b) / len(a | b))
    # Without the correction unlike texts would stand at 1/256; few shingles leave few bins to differ.
    assert max(map(abs, errors)) < 0.5 and abs(sum(errors) / len(errors)) < 0.01
    long = errors[len(errors) // 2 :]
    assert max(map(abs, long)) < 0.13


def test_correction_of_chance_matches(spark):
    rnd = random.Random(8)
    rows = [(random_text(rnd, 400, 10**6), random_text(rnd, 400, 10**6)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    marks = with_fingerprint(with_fingerprint(df, "a", "fa", 8, 4), "b", "fb", 8, 4)
    row = marks.select(likeness(F.col("fa"), F.col("fb"), 8, 4).alias("near")).agg(F.avg("near")).first()
    assert row[0] < 0.02  # one in sixteen bins agrees by chance


def test_next_texts(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 14] + [(-3, "ü" * 7), (10**12, "abc")]
    found = with_next(messy(spark, rows, 5), lambda df: df.withColumn("about", F.md5("text"))).collect()
    want = [
        (i, n, e, hashlib.md5(after.encode()).hexdigest()) for i, n, e, after in edited(rows)
    ]
    assert sorted((r.id, r.n_chars, r.kept + r.next_head, r.next_about) for r in found) == sorted(want)


def test_repeated_rows_null_ids_and_few_rows(spark):
    about = lambda df: df.withColumn("about", F.col("text"))
    rows = [(None, "none")] * 200 + [(5, "five")] * 3 + [(7, "seven"), (7, "other")]
    found = with_next(messy(spark, rows, 7), about).collect()
    by_text = {r.about: r for r in found}
    assert len(found) == 205 and len(by_text) == 4
    assert by_text["five"].next_about == "none" and by_text["none"].id is None
    # Both rows of id 7 come first, one after the other; the last row is followed by the first.
    order = [by_text["none"].next_about]
    order.append(by_text[order[0]].next_about)
    assert set(order) == {"seven", "other"} and by_text[order[1]].next_about == "five"
    (one,) = with_next(messy(spark, [(1, "abcd")], 1), about).collect()
    assert (one.kept, one.next_head) == ("ab", "ab")
    assert with_next(nothing(spark), about).count() == 0


def test_order_does_not_depend_on_the_number_of_tasks(spark):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 9)) for i in range(1000)]
    want = sorted((i, n, e) for i, n, e, _ in edited(rows))
    for spread in (1, 13):
        found = with_next(messy(spark, rows, spread), lambda df: df.withColumn("about", F.lit(1))).collect()
        assert sorted((r.id, r.n_chars, r.kept + r.next_head) for r in found) == want


def test_query_against_the_definition(spark):
    docs = [tuple(r) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in queries.op13_document_fingerprints(spark, FOLDER).collect()}
    assert len(found) == len(docs)
    marks = {i: by_definition(t) for i, t in docs}
    for i, n, text, after in edited(docs):
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (marks[i], by_definition(text))
        same = lambda a, b: sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 512, 2)) / 256
        for near, other in ((r.near_edited, by_definition(text)), (r.near_next, by_definition(after))):
            if marks[i] and other:
                assert near == pytest.approx(max(0.0, (same(marks[i], other) - 1 / 256) / (255 / 256)))


def test_runs_no_python_and_gathers_nothing(spark):
    df = queries.op13_document_fingerprints(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
    assert "SinglePartition" not in plan
