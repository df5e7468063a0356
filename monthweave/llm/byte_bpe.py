"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut into chunks that overlap, the chunks are pre-tokenised in parallel, and a
chunk takes over from its predecessor at the first pre-token boundary on which both agree
within the overlap: from a common boundary on, both continue alike, since the pattern
never looks back. The pieces between such boundaries are then encoded, each match of the
pattern separately, and put together in order. A text of one chunk needs no stitching
and no shuffle. A text in which a border falls into a pre-token longer than the overlap has
no common boundary there and is encoded as one piece.

Long texts are cut and written once; boundaries, pieces and texts that stay whole are read from
there.

Decoding concatenates the bytes of the ids; a text's bytes come back exactly.

Cases: a null text counts as empty and has no ids. Repeated rows are encoded each, null ids are
carried along, and an empty table gives no rows. Other columns are ignored. An id
outside the vocabulary fails.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, cut, keep, with_row
from monthweave.llm.words import small_batches

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 11
#: Matches that end this near the end of a chunk may go on behind it.
MARGIN_CHARS = 8
#: Encoded pre-tokens that a worker remembers; it starts afresh when they are more.
REMEMBERED = 300_000
#: Pre-tokens up to this many bytes are merged by scanning, longer ones with a heap.
SCAN_BYTES = 48


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes in the order of their ids, and the pattern of pre-tokens."""

    tokens: tuple[bytes, ...]
    pattern: str


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: on each line a token in base64 and its id."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return Vocabulary(tuple(found[i] for i in range(len(found))), pattern)


class Encoder:
    """Encodes pre-tokens; lives in a Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.ranks = {token: i for i, token in enumerate(vocabulary.tokens)}
        self.split = regex.compile(vocabulary.pattern)
        self.known: dict[str, bytes] = {}

    def merged(self, token: bytes) -> list[int]:
        """Ids after merging, again and again, the leftmost pair of the least rank."""
        ranks = self.ranks
        if token in ranks:
            return [ranks[token]]
        if len(token) > SCAN_BYTES:
            return self._merged_long(token)
        find, none = ranks.get, len(ranks)  # a rank beyond all stands for no token
        parts = [token[i : i + 1] for i in range(len(token))]
        costs = [find(token[i : i + 2], none) for i in range(len(token) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i] = self.tokens[least]
            del parts[i + 1], costs[i]
            if i < len(costs):
                costs[i] = find(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = find(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merged_long(self, token: bytes) -> list[int]:
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))  # of the part that starts here; 0 if none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(token[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(token[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def ids(self, pre_tokens: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        try:
            return b"".join([known[t] for t in pre_tokens])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            fresh = {t: b"" for t in pre_tokens if t not in known}
            for t in fresh:
                fresh[t] = np.array(self.merged(t.encode()), "<u4").tobytes()
            known.update({t: v for t, v in fresh.items() if len(t) <= SCAN_BYTES})
            return b"".join([known.get(t) or fresh[t] for t in pre_tokens])


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker and vocabulary."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class SharedVocabulary:
    """A vocabulary on all workers; its size does not depend on the data."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary):
        self._sent = spark.sparkContext.broadcast(vocabulary)
        self.id = hash((vocabulary.pattern, vocabulary.tokens))

    @property
    def value(self) -> Vocabulary:
        return self._sent.value


def _encode_whole(shared: SharedVocabulary) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in small_batches(batches):
            ids = [encoder.ids(encoder.split.findall(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("id"), pa.array(ids, pa.binary())],
                [ROW, "id", "ids"],
            )

    return encode


def _chunks(chunk_chars: int, overlap: int) -> Callable:
    """Chunks of long texts, each with the beginning of the next one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for row, name, cell in zip(*(batch.column(n) for n in (ROW, "id", "text"))):
                text = cell.as_py()
                for low in range(0, len(text), chunk_chars):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.as_py()], pa.int64()),
                            pa.array([name.as_py()], pa.int64()),
                            pa.array([low // chunk_chars], pa.int32()),
                            pa.array([text[low : low + chunk_chars + overlap]]),
                        ],
                        [ROW, "id", "chunk", "part"],
                    )

    return chunks


def _boundaries(shared: SharedVocabulary, chunk_chars: int, overlap: int) -> Callable:
    """Pre-token starts of a chunk within its two overlaps, as places in the text."""

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = _encoder(shared).split
        for batch in batches:
            heads, tails = [], []
            for chunk, text in zip(batch["chunk"], batch["part"]):
                low = chunk * chunk_chars
                sure = len(text) - MARGIN_CHARS
                head, tail = [], []
                for m in split.finditer(text):
                    at = m.start()
                    if at <= overlap:
                        head.append(low + at)
                    if chunk_chars <= at <= sure:
                        tail.append(low + at)
                heads.append(head)
                tails.append(tail)
            yield batch[[ROW, "chunk"]].assign(head=heads, tail=tails)

    return borders


def _stitched(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each chunk of one text takes over; -1 where it never can.

    Bounded by the overlaps of one text, not by the number of texts.
    """
    rows = rows.sort_values("chunk")
    starts, before = [], None
    for chunk, head, tail in zip(rows["chunk"], rows["head"], rows["tail"]):
        if not chunk:
            starts.append(0)
        else:
            common = sorted(set(before).intersection(head))
            starts.append(common[0] if common else -1)
        before = tail
    starts = np.array(starts, np.int64)
    if (starts < 0).any():
        starts[:] = -1
    stops = np.append(starts[1:], -1)
    return pd.DataFrame(
        {ROW: rows[ROW].to_numpy(), "chunk": rows["chunk"].to_numpy(), "start": starts, "stop": stops}
    )


def _encode_pieces(shared: SharedVocabulary, chunk_chars: int) -> Callable:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for batch in batches:
            out = []
            for chunk, part, start, stop in zip(
                batch["chunk"], batch["part"], batch["start"], batch["stop"]
            ):
                low = chunk * chunk_chars
                end = len(part) if stop < 0 else stop - low
                tokens = []
                for m in encoder.split.finditer(part, start - low):
                    if m.start() >= end:
                        break
                    tokens.append(m.group())
                out.append(encoder.ids(tokens))
            yield batch[[ROW, "chunk"]].assign(ids=out)

    return encode


def encode(
    docs: DataFrame,
    shared: SharedVocabulary,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Columns _row (place in ``docs``), id, ids (binary, little-endian unsigned 32-bit)."""
    texts = with_row(docs).select(
        ROW,
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    size = F.length("text")
    # Written once: no later step depends on how rows are numbered when they are read again.
    chunks = keep(
        texts.filter(size > chunk_chars)
        .mapInArrow(_chunks(chunk_chars, overlap), f"{ROW} long, id long, chunk int, part string")
        .repartition(ROW, "chunk"),
        "chunks",
    )
    borders = chunks.select(ROW, "chunk", "part").mapInPandas(
        _boundaries(shared, chunk_chars, overlap),
        f"{ROW} long, chunk int, head array<long>, tail array<long>",
    )
    pieces = cut(
        borders.groupBy(ROW).applyInPandas(
            _stitched, f"{ROW} long, chunk int, start long, stop long"
        )
    )
    unstitched = pieces.filter("start < 0").select(ROW).distinct()
    encode_whole = _encode_whole(shared)
    kinds = f"{ROW} long, id long, ids binary"
    short = texts.filter(size <= chunk_chars).mapInArrow(encode_whole, kinds)
    own = F.struct("chunk", F.substring("part", 1, chunk_chars).alias("part"))
    in_order = F.transform(F.array_sort(F.collect_list(own)), lambda c: c["part"])
    whole = (
        chunks.join(unstitched, ROW, "left_semi")
        .groupBy(ROW, "id")
        .agg(F.array_join(in_order, "").alias("text"))
        .mapInArrow(encode_whole, kinds)
    )
    encoded = (
        chunks.join(pieces.filter("start >= 0"), [ROW, "chunk"])
        .select(ROW, "chunk", "part", "start", "stop")
        .mapInPandas(_encode_pieces(shared, chunk_chars), f"{ROW} long, chunk int, ids binary")
    )
    names = chunks.filter("chunk = 0").select(ROW, "id")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda p: F.hex(p["ids"])), ""
    )
    stitched = (
        encoded.groupBy(ROW).agg(F.unhex(joined).alias("ids")).join(names, ROW).select(ROW, "id", "ids")
    )
    return short.unionByName(whole).unionByName(stitched)


def _decode(shared: SharedVocabulary) -> Callable:
    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in small_batches(batches, "ids"):
            texts = [
                None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                for ids in batch.column("ids").to_pylist()
            ]
            kept = [batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return decode_batches


def decode(encoded: DataFrame, shared: SharedVocabulary) -> DataFrame:
    """Add ``decoded``: the bytes of ``ids``, null where these are null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decode(shared), f"{kinds}, decoded binary")
