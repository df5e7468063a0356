from __future__ import annotations

import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from monthweave.llm import byte_bpe
from tests.llm.cases import TEXTS, messy, nothing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def shared(spark):
    return byte_bpe.SharedVocabulary(spark, byte_bpe.read_vocabulary(PATH, public_tokenizers.PATTERN))


def texts():
    rnd = random.Random(3)
    every = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    bits = ["'re", "'", "r", "e", " ", "\n", "  ", "1", "é", "word", "!!", "\x85", "\x1c", "　", "<|endoftext|>"]
    out = [t for _, t in TEXTS]
    out += [None, "", "a" * 3000, " " * 2000 + "x", "it's we're\n\n word  \t\n x" * 100, every[:70000], every[-3000:]]
    return out + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(700))) for _ in range(150)]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 11), (100, 30), (300, 64)])
def test_ids_are_those_of_the_library(spark, library, shared, chunk, overlap):
    rows = list(enumerate(texts()))
    out = byte_bpe.decode(byte_bpe.encode(messy(spark, rows), shared, chunk_chars=chunk, overlap=overlap), shared)
    found = {r.id: (bytes(r.ids), bytes(r.decoded)) for r in out.collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        ids, decoded = found[i]
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text or "")
        assert decoded == (text or "").encode()


def test_ids_of_any_mixture(library):
    """White space, letters, numbers and marks in any order; words that a worker forgets."""
    encoder = byte_bpe.Encoder(byte_bpe.read_vocabulary(PATH, public_tokenizers.PATTERN))
    rnd = random.Random(8)
    bits = [" ", "  ", "\t", "\n", "\r\n", "\x85", "\x1c", "\x1f", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b",
            "'s", "'", "a", "bc", "É", "中", "7", "½", "!", "...", "\x00", "\u0301", "🙂", "ing", "tion", "zq"]
    for _ in range(20000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(20)))
        ids = library.encode_ordinary(text)
        assert encoder.ids(encoder.split.findall(text)) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        if rnd.random() < 0.001:
            encoder.known.clear()


def test_file_splits_between_building_and_running_change_nothing(spark, library, shared, tmp_path):
    """Long and short texts of one file that is cut otherwise when the query runs."""
    rows = [(i, f"text {i} " * (5 + 400 * (i % 7 == 0))) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option(
        "parquet.block.size", 1 << 14).parquet(path)
    least = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(least, None)
    try:
        spark.conf.set(least, "2")
        built = byte_bpe.encode(spark.read.parquet(path), shared, chunk_chars=1000, overlap=64)
        spark.conf.set(least, "16")
        found = {r.id: bytes(r.ids) for r in built.collect()}
    finally:
        spark.conf.unset(least) if before is None else spark.conf.set(least, before)
    assert len(found) == len(rows)
    for i, text in rows:
        ids = library.encode_ordinary(text)
        assert found[i] == struct.pack(f"<{len(ids)}I", *ids)


def test_repeated_rows_null_ids_and_empty_table(spark, shared):
    found = byte_bpe.encode(messy(spark), shared).collect()
    assert sorted(map(repr, (r.id for r in found))) == sorted(map(repr, (i for i, _ in TEXTS)))
    assert len({r._row for r in found}) == len(TEXTS)
    assert byte_bpe.decode(byte_bpe.encode(nothing(spark), shared), shared).count() == 0


def test_unknown_id_fails(spark, shared):
    bad = spark.createDataFrame([(1, bytearray(struct.pack("<I", 10**6)))], "id long, ids binary")
    with pytest.raises(Exception, match="IndexError|out of range"):
        byte_bpe.decode(bad, shared).collect()
