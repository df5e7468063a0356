"""Small tables with everything that must not break an operator."""

from __future__ import annotations

import random
import re

LONG = "long text without end " * 4000
SHARED = " ".join(f"shared{i} words{i} of{i} a{i} passage{i}" for i in range(20))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"),
    (2, "The quick brown fox jumps over the lazy dog and runs away"),
    (3, "the quick  brown fox\njumps over the lazy dog and runs away"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b\x0c\r "),
    (7, "one"),
    (8, "one"),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (9, LONG),
    (10, LONG + "end"),
    (11, SHARED),
    (12, "before it " + SHARED + " after it"),
    (13, "été ñandú straße 中文  \x85 \x00 zero"),
    (14, "repeated row"),
    (14, "repeated row"),
    (15, "12345 !!! ..."),
    (16, "x" * 50000),
]
SCHEMA = "doc_id long, text string"


def messy(spark, rows=None, spread: int = 3):
    """The rows with further columns that have names operators use themselves, written once."""
    from monthweave.llm.storage import keep

    rows = TEXTS if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(spread)
    return keep(
        df.selectExpr(
            "*", "'x' AS id", "-1 AS _row", "'y' AS score", "3 AS n", "'k' AS key", "0.5 AS kept",
            "'en' AS lang", "'host' AS source", "cast(length(text) AS long) AS n_chars",
        ),
        "messy",
    )


def nothing(spark):
    return messy(spark, [], 1)


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def random_text(rnd: random.Random, size: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(size))


def changed(rnd: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
    return " ".join(w)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
