"""Alignment of the tokens that two tokenizers make of the same texts, and counts of what is linked.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a piece model that
adds the space itself (B). The byte offsets where tokens end are keys of two dictionaries; the
keys that both have, sorted, cut the two lists of ids into groups that cover the same bytes.
Within a group each A token is linked with each B token that it shares a byte with: one token
with all of the other side, or else by the ends within the group.

How often a pair of ids is linked is counted over the whole corpus, from each text's distinct pairs:
summed in each task, then by one shuffle. The HEAD most frequent pairs, a table of fixed
size, are broadcast to look up their counts; the others meet theirs in a shuffle join, where no key
is frequent, since all of the head's pairs are more frequent.

Each text is encoded whole, within one task, in small batches; memory is some hundred bytes
for each token of a batch, and a very long text is a batch of its own.

Cases: a null or empty text has no tokens, and so has one of which either tokenizer's bytes are not the
space and the text (one that drops or rewrites characters). Special tokens' names within texts
are plain text. Repeated rows count each, null ids are carried along, ties for the highest
count are all highest, other columns are ignored whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, keep, largest, with_row
from monthweave.llm.words import small_batches

#: Pairs of ids that are looked up in a broadcast; the others are joined.
HEAD = 1 << 18
BATCH_BYTES = 1 << 19
#: A pair of ids as one number.
B_BITS = 32


class ByteLevelBPE:
    """A byte-level BPE from its JSON file, whose merges must be in the order of their ids."""

    def __init__(self, content: bytes, pattern: str):
        model = json.loads(content)["model"]
        byte = byte_of_character()
        ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("merges are not in the order of their ids")
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self._coding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ids, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self._coding.encode_ordinary(" " + t) for t in texts]


class PieceModel:
    """A sentencepiece model with byte fallback that puts a space before a text."""

    def __init__(self, content: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.tokens = [self._bytes(i) for i in range(self._model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        if self._model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._model.encode(list(texts), num_threads=1)


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others come from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Tokenizers:
    """Both tokenizers on all workers, as the contents of their files; made once in each."""

    a: bytes
    b: bytes
    pattern: str
    _made: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"a": self.a, "b": self.b, "pattern": self.pattern, "_made": None}

    def made(self) -> tuple[ByteLevelBPE, PieceModel]:
        if self._made is None:
            self._made = ByteLevelBPE(self.a, self.pattern), PieceModel(self.b)
        return self._made


def share_tokenizers(spark: SparkSession, a_path: str, b_path: str, pattern: str):
    """A broadcast of the two files, whose size does not depend on the data."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast(Tokenizers(a.read(), b.read(), pattern))


def covered(ids: list[int], tokens: list[bytes], text: bytes) -> bool:
    return b"".join(map(tokens.__getitem__, ids)) == text


def group_stops(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of either side there are up to the end of each group, from the byte
    offsets where tokens end. A group ends where a token of either side ends.
    """
    a_at, b_at = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))
    # A dictionary keeps the order of its keys, and ends rise, so the common keys come sorted.
    common = list(filter(b_at.__contains__, a_at))
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def links(
    a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, a_len: np.ndarray, b_len: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids that are linked, as numbers in the order of the groups, and how many
    each group has.

    A group in which no token ends together with another before its end has as many links as
    tokens, less one.
    """
    n = a_sizes + b_sizes - 1
    low_a, low_b = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at_a = np.repeat(low_a, n) + np.where(np.repeat(a_sizes, n) == 1, 0, step)
    at_b = np.repeat(low_b, n) + np.where(np.repeat(b_sizes, n) == 1, 0, step)
    many = (a_sizes > 1) & (b_sizes > 1)
    if many.any():
        # Both sides cover the same bytes up to the end of every group, so their ends compare.
        end_a, end_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        ends = np.unique(
            np.concatenate([end_a[np.repeat(many, a_sizes)], end_b[np.repeat(many, b_sizes)]])
        )
        of_many = np.repeat(many, n)
        at_a[of_many] = np.searchsorted(end_a, ends)
        at_b[of_many] = np.searchsorted(end_b, ends)
    return (a[at_a] << B_BITS) | b[at_b], n


class Batch:
    """The tokens and groups of some texts, each side in one array, and where each text's begin."""

    def __init__(self, texts: Sequence[str], a: ByteLevelBPE, b: PieceModel):
        a_ids, b_ids = a.encode(texts), b.encode(texts)
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or not covered(a_ids[i], a.tokens, whole) or not covered(b_ids[i], b.tokens, whole):
                a_ids[i] = b_ids[i] = []
        self.a_len, self.b_len = np.array(list(map(len, a.tokens))), np.array(list(map(len, b.tokens)))
        self.a, self.a_at = _joined(a_ids)
        self.b, self.b_at = _joined(b_ids)
        # Both sides of each text cover the same bytes, so offsets can go on from text to text.
        a_ends, b_ends = np.cumsum(self.a_len[self.a]).tolist(), np.cumsum(self.b_len[self.b]).tolist()
        within = lambda ends, at: [ends[low:high] for low, high in zip(at.tolist(), at[1:].tolist())]
        stops = [group_stops(*sides) for sides in zip(within(a_ends, self.a_at), within(b_ends, self.b_at))]
        a_stops, self.at = _joined([a for a, _ in stops])
        b_stops, _ = _joined([b for _, b in stops])
        self.a_sizes = _sizes(a_stops, self.a_at, self.at)
        self.b_sizes = _sizes(b_stops, self.b_at, self.at)

    def texts_of_groups(self, names: tuple[np.ndarray, ...]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text: the ids of both sides of every group."""
        a_more, a_last, b_more, b_last = names
        a_stop, b_stop = np.cumsum(self.a_sizes), np.cumsum(self.b_sizes)
        out = np.empty(len(self.a) + len(self.b), object)
        a_names, b_names = a_more[self.a], b_more[self.b]
        a_names[a_stop - 1], b_names[b_stop - 1] = a_last[self.a[a_stop - 1]], b_last[self.b[b_stop - 1]]
        # The A tokens of a group come behind the B tokens of the groups before it, its B tokens behind them.
        out[np.arange(len(self.a)) + np.repeat(b_stop - self.b_sizes, self.a_sizes)] = a_names
        out[np.arange(len(self.b)) + np.repeat(a_stop, self.b_sizes)] = b_names
        at = (self.a_at + self.b_at).tolist()
        return ["".join(out[low:high].tolist())[:-1] for low, high in zip(at, at[1:])]

    def pairs(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The distinct linked pairs of each text and how many links each has."""
        codes, n = links(self.a, self.b, self.a_sizes, self.b_sizes, self.a_len, self.b_len)
        at = np.concatenate([[0], np.cumsum(n)])[self.at].tolist()
        found = [np.unique(codes[low:high], return_counts=True) for low, high in zip(at, at[1:])]
        return [pair for pair, _ in found], [times for _, times in found]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(list(map(len, lists)))]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(at[-1])), at


def _sizes(stops: np.ndarray, tokens_at: np.ndarray, groups_at: np.ndarray) -> np.ndarray:
    """How many tokens each group has, from the tokens of its text up to its end."""
    return np.diff(stops + np.repeat(tokens_at[:-1], np.diff(groups_at)), prepend=0)


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values).cast(kind))


def _names(tokens: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(tokens)], object)


def _align(shared) -> Callable:
    def align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value.made()
        names = tuple(_names(len(t.tokens), end) for t, end in ((a, ","), (a, "|"), (b, ","), (b, ";")))
        for rows in small_batches(batches, limit=BATCH_BYTES):
            batch = Batch([t.as_py() or "" for t in rows.column("text")], a, b)
            pairs, times = batch.pairs()
            at = np.concatenate([[0], np.cumsum(list(map(len, pairs)))])
            flat = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(ROW),
                    rows.column("id"),
                    _lists(batch.a, batch.a_at, pa.int32()),
                    _lists(batch.b, batch.b_at, pa.int32()),
                    _lists(batch.a_sizes, batch.at, pa.int32()),
                    _lists(batch.b_sizes, batch.at, pa.int32()),
                    pa.array(batch.texts_of_groups(names), pa.string()),
                    _lists(flat(pairs), at, pa.int64()),
                    _lists(flat(times), at, pa.int64()),
                ],
                [ROW, "id", "a_ids", "b_ids", "a_sizes", "b_sizes", "groups", "pairs", "times"],
            )

    return align_batches


def align(
    docs: DataFrame, shared, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns _row, id, a_ids, b_ids, a_sizes, b_sizes (tokens of either side in each group), groups (the
    same as text, a1,a2|b1;a3|b2,b3), pairs (distinct linked pairs, a * 2**32 + b) and times (their links).

    Write what is wanted of it, as ``keep`` does, before handing it to the functions below: they
    read _row, pairs and times more than once.
    """
    slim = with_row(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    kind = slim.schema["id"].dataType.simpleString()
    ints = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    return slim.select(ROW, "id", "text").mapInArrow(
        _align(shared),
        f"{ROW} long, id {kind}, {ints}, groups string, pairs array<long>, times array<long>",
    )


def _links(aligned: DataFrame) -> DataFrame:
    pairs = aligned.select(ROW, F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    return pairs.select(ROW, F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Columns a, b, pair (both ids as one number), n (links of the pair in all rows), is_best
    (no pair of the same ``b`` has more). Written, one row for each pair that is linked.
    """
    counted = keep(
        _links(aligned)
        .groupBy("pair")
        .agg(F.sum("times").alias("n"))
        .withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1).cast("int")),
        "pair-counts",
    )
    best = counted.groupBy("b").agg(F.max("n").alias("most"))
    is_best = (F.col("n") == F.col("most")).alias("is_best")
    a = F.shiftright("pair", B_BITS).cast("int").alias("a")
    return keep(counted.join(best, "b").select(a, "b", "pair", "n", is_best), "pairs")


def link_statistics(aligned: DataFrame, pairs: DataFrame, head_pairs: int = HEAD) -> DataFrame:
    """Columns _row, n_links, n_best (links whose pair ``is_best``), count_sum (the counts of the pairs of
    all links); one row for each row of ``aligned`` that has a link.
    """
    counts = pairs.select("pair", "n", "is_best")
    # At most ``head_pairs`` rows of 17 bytes; written, so that both uses below have the same.
    head = keep(largest(counts, "n", head_pairs), "head-pairs")

    def summed(links: DataFrame) -> DataFrame:
        return links.groupBy(ROW).agg(
            F.sum("times").alias("n_links"),
            F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )

    known = summed(_links(aligned).join(F.broadcast(head), "pair"))
    beyond = _links(aligned).join(F.broadcast(head.select("pair")), "pair", "left_anti")
    both = known.unionByName(summed(beyond.join(counts, "pair")))
    return both.groupBy(ROW).agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
