from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from monthweave.llm import queries
from monthweave.llm import token_alignment as module
from monthweave.llm.storage import keep
from tests.llm.cases import TEXTS, messy, nothing

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Libraries:
    """Ids and bytes of tokens from the two libraries that the files are made for."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        byte = module.byte_of_character()
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def b_byte(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        tokens = [(i, self.a_bytes[i]) for i in a], [(i, self.b_byte(i)) for i in b]
        whole = (" " + text).encode()
        return tokens if all(b"".join(t for _, t in side) == whole for side in tokens) else ([], [])


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


@pytest.fixture(scope="module")
def shared(spark):
    return module.share_tokenizers(spark, A, B, public_tokenizers.PATTERN)


def spans(side):
    ends = list(accumulate(len(t) for _, t in side))
    return [(i, lo, hi) for (i, _), lo, hi in zip(side, [0, *ends], ends)]


def linked(a, b):
    """All pairs of occurrences whose byte ranges overlap."""
    return [(i, j) for i, lo, hi in spans(a) for j, low, high in spans(b) if lo < high and low < hi]


def groups(a, b):
    out, last = [], 0
    for end in sorted({hi for _, _, hi in spans(a)} & {hi for _, _, hi in spans(b)}):
        within = lambda side: ",".join(str(i) for i, lo, hi in spans(side) if lo >= last and hi <= end)
        out.append(f"{within(a)}|{within(b)}")
        last = end
    return ";".join(out)


def expected(libraries, rows):
    """The contract's numbers for (id, text) rows, from their definitions."""
    sides = [(i, *libraries.tokens(text)) for i, text in rows]
    of_row = [linked(a, b) for _, a, b in sides]
    counts = Counter(pair for pairs in of_row for pair in pairs)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for (i, a, b), pairs in zip(sides, of_row):
        text = groups(a, b)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(counts[p] == most[p[1]] for p in pairs)
        out.append((i, len(a), len(b), text.count(";") + 1 if a else 0, len(pairs), best, sum(counts[p] for p in pairs), sha))
    return sorted(out, key=repr)


def texts():
    rnd = random.Random(4)
    bits = ["'re", "'", "r", " ", "\n", "  ", "1", "é", "word", "!!", "\x85", "　", "<|endoftext|>", "<s>", "<0x41>",
            "▁", "中文", "ﬁ", "\t", "\x00", "​", "😀", "á"]
    short = [t for t in (t for _, t in TEXTS) if len(t or "") < 3000]
    return short + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(120)]


def numbers(spark, docs, shared, head):
    aligned = keep(module.align(docs, shared), "test-aligned")
    pairs = module.pair_counts(aligned)
    stats = module.link_statistics(aligned, pairs, head)
    return aligned, pairs, {r._row: r for r in stats.collect()}


@pytest.mark.parametrize("head, batch", [(1 << 18, 1 << 19), (40, 200), (0, 1)])
def test_numbers_are_those_of_the_libraries(spark, libraries, shared, monkeypatch, head, batch):
    monkeypatch.setattr(module, "BATCH_BYTES", batch)
    rows = list(enumerate(texts())) + [(None, "a row"), (None, "a row")]
    aligned, _, stats = numbers(spark, messy(spark, rows), shared, head)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    found = []
    for r in aligned.collect():
        n = stats.get(r._row)
        of_links = (n.n_links, n.n_best, n.count_sum) if n else (0, 0, 0)
        assert (sum(r.a_sizes), sum(r.b_sizes), sum(r.times)) == (len(r.a_ids), len(r.b_ids), of_links[0])
        found.append((r.id, len(r.a_ids), len(r.b_ids), len(r.a_sizes), *of_links, sha(r.groups)))
    assert sorted(found, key=repr) == expected(libraries, rows)


def test_pairs_and_ties(spark, libraries, shared):
    rows = list(enumerate(texts()))
    _, pairs, _ = numbers(spark, messy(spark, rows), shared, 100)
    counts = Counter(p for _, text in rows for p in linked(*libraries.tokens(text)))
    found = {(r.a, r.b): (r.n, r.is_best) for r in pairs.collect()}
    most = {b: max(n for (_, c), n in counts.items() if c == b) for _, b in counts}
    assert found == {(a, b): (n, n == most[b]) for (a, b), n in counts.items()}
    assert max(Counter(b for (_, b), (_, best) in found.items() if best).values()) > 1  # ties are all best


def test_links_within_groups():
    """Groups of one token on a side, and one in which no inner ends meet."""
    a, b = np.array([0, 1, 2, 3, 4, 5]), np.array([0, 1, 2, 3, 4])
    a_len, b_len = np.array([2, 3, 1, 2, 3, 1]), np.array([1, 1, 4, 3, 3])
    # bytes: |0 0|1 1 1 2|3 3 4 4 4 5|  and  |0 1|2 2 2 2|3 3 3 4 4 4|
    codes, n = module.links(a, b, np.array([1, 2, 3]), np.array([2, 1, 2]), a_len, b_len)
    assert n.tolist() == [2, 2, 4]
    assert [(c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()] == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3), (4, 3), (4, 4), (5, 4)]


def test_merges_out_of_order_are_refused():
    import json

    with open(A, "rb") as file:
        content = json.load(file)
    merges = content["model"]["merges"]
    merges[5], merges[6] = merges[6], merges[5]
    with pytest.raises(ValueError, match="order"):
        module.ByteLevelBPE(json.dumps(content).encode(), public_tokenizers.PATTERN)


def test_long_texts_and_empty_table(spark, shared):
    rows = [(1, "long text without end " * 4000), (2, "x" * 50000), (3, None), (4, "")]
    aligned, _, stats = numbers(spark, messy(spark, rows), shared, 10)
    found = {r.id: (r, stats.get(r._row)) for r in aligned.collect()}
    assert found[1][1].n_links > 10000 and len(found[2][0].a_ids) > 1000
    assert all(found[i][1] is None and found[i][0].groups == "" for i in (3, 4))
    aligned, pairs, stats = numbers(spark, nothing(spark), shared, 10)
    assert aligned.count() == pairs.count() == len(stats) == 0


def test_query_against_the_libraries(spark, libraries):
    docs = [tuple(r) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 2500]
    found = queries.op12_token_alignment(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in docs)
    want = {r[0]: r for r in expected(libraries, short)}
    sizes = {r.doc_id: r for r in found}
    for i, row in want.items():
        r = sizes[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*row[1:5], row[7])
        # Counts over the short texts alone are no greater.
        assert r.count_sum >= row[6]
