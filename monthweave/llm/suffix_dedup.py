"""Removal of long repeated substrings, byte by byte, across and within texts.

Every window of ``length`` bytes belongs to the least hash among the anchors, shorter
substrings, that it contains; equal windows have equal anchors. The windows of a text with the
same anchor place form a segment. Texts are read once for their anchors; anchors that occur
once are dropped by a grouped count. The segments of the others are cut out of the texts, equal ones of an anchor
are counted and moved once, and the different ones meet in blocks, whole anchors to a block, in
which a Burrows-Wheeler transform finds the repeated windows (see ``bwt``). Their places go back to the
texts, where the covered bytes are removed.

An anchor with more than ``GROUP_STRINGS`` different segments is divided: into pieces of
``PIECE_WINDOWS`` windows at the same places relative to the anchor, told apart by the bytes
that all windows of the piece share, and what is still too large into single windows. So no
group of a block grows with the data, and no window is lost.

Cases: a null text counts as empty; a text shorter than ``length`` keeps all its bytes.
Repeated rows repeat each other. Null ids are carried along. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthweave.llm.bwt import repeated_windows
from monthweave.llm.storage import ROW, cut, discard, keep, release, with_row
from monthweave.llm.words import U64, mixed, small_batches, text_bytes

LENGTH = 200
#: Share of the length that an anchor takes: longer anchors are more, but rarer by chance.
ANCHOR_SHARE = 0.4
GROUP_STRINGS = 2048
PIECE_WINDOWS = 16
#: Bytes of the segments in a block.
BLOCK_BYTES = 1 << 17
#: Strings of groups without a transform that are handed on together.
WHOLE_ROWS = 1 << 14
#: Segments a task knows to have sent; it starts afresh when they are more.
REMEMBERED = 300_000
#: Bytes whose anchors are found at a time; places within must fit PLACE_BITS.
SPAN = 1 << 17
PLACE_BITS = 18

_STEP = 0x9E3779B97F4A7C15
_random = np.random.Generator(np.random.PCG64(1234567))
_BYTE = _random.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)


def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def anchor_runs(
    data: np.ndarray, starts: np.ndarray, length: int, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor hash of every run of windows of a
    row that share an anchor place. Runs are also cut every SPAN bytes.

    The anchor's place is the last one given: rows, windows, runs, places, hashes.
    """
    up, down = _powers(_STEP, SPAN + length), _powers(pow(_STEP, -1, 1 << 64), SPAN + length)
    out: list[tuple] = []
    for low in range(0, max(0, len(data) - length + 1), SPAN):
        part = data[low : low + SPAN + length - 1]
        n = len(part) - length + 1
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        hashes = mixed((sums[size:] - sums[:-size]) * down[: len(part) - size + 1])
        places = np.arange(len(hashes), dtype=U64)
        least = (hashes >> U64(PLACE_BITS) << U64(PLACE_BITS)) | places
        width, span = length - size + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: n], least[width - span :])
        place = (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        row = np.searchsorted(starts, low + np.arange(n), "right") - 1
        valid = low + np.arange(n) + length <= starts[row + 1]
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, n))
        use = valid[at]
        at, runs = at[use], runs[use]
        out.append((row[at], low + at - starts[row[at]], runs, place[at] - at, hashes[place[at]]))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors(length: int, size: int) -> Callable:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, starts = text_bytes(batch.column("text"))
            row, first, runs, place, hashes = anchor_runs(data, starts, length, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW).take(pa.array(row)),
                    pa.array(hashes.view(np.int64)),
                    pa.array(first << 24 | runs << 8 | place),
                ],
                [ROW, "anchor", "run"],
            )

    return anchors


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in small_batches(batches):
        packed = [pack(t.as_py().encode()) for t in batch.column("text")]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "packed"]
        )


def _digest(*parts: bytes) -> int:
    state = blake2b(digest_size=8)
    for part in parts:
        state.update(part)
    return int.from_bytes(state.digest(), "little", signed=True)


def _segments(length: int) -> Callable:
    """Cut the segments out; of equal ones in a task only the first carries its bytes, or the
    first since the task last forgot what it had seen."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small_batches(batches, "packed"):
            out: list[tuple] = []
            if len(seen) > REMEMBERED:
                seen.clear()
            for row, packed, anchors, runs in zip(
                batch.column(ROW).to_pylist(),
                batch.column("packed"),
                batch.column("anchors").to_pylist(),
                batch.column("runs").to_pylist(),
            ):
                data = unpack(packed.as_py())
                for anchor, run in zip(anchors, runs):
                    first, count, place = run >> 24, run >> 8 & 0xFFFF, run & 0xFF
                    string = data[first : first + count + length - 1]
                    key = (anchor, _digest(string))
                    out.append((row, first, *key, place, None if key in seen else string))
                    seen.add(key)
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                [ROW, "first", "grp", "digest", "place", "string"],
            )

    return segments


def _pieces(length: int, windows: int) -> Callable:
    """Divide strings at multiples of ``windows`` places relative to their anchors."""
    windows = min(windows, length)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "string"):
            out: list[tuple] = []
            for grp, digest, place, string, times in zip(
                *(batch.column(n).to_pylist() for n in ("grp", "digest", "place", "string", "times"))
            ):
                count = len(string) - length + 1
                at = 0
                while at < count:
                    # Counted from the anchor, so that equal windows get equal pieces.
                    piece = (at - place) // windows
                    low = piece * windows + place
                    stop = min(count, low + windows)
                    part = string[at : stop + length - 1]
                    core = string[low + windows - 1 : low + length]
                    inner = _digest(grp.to_bytes(8, "little", signed=True), str(piece).encode(), core)
                    out.append((grp, digest, at, inner, _digest(part), place - at, part, times))
                    at = stop
            names = ["of_grp", "of_digest", "shift", "grp", "digest", "place", "string", "times"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pieces


def _repeated(length: int) -> Callable:
    """Blocks of whole groups, which come one after the other, through the transform.

    All windows of a string that occurs several times are repeated, so a group of nothing else needs no
    transform. Nor does a single string that occurs once: its windows hold their anchor at
    different places, and equal windows hold it at the same one.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        whole: list[tuple] = []
        group: list[tuple] = []
        held = 0

        def solve() -> pa.RecordBatch:
            found = list(whole)
            if rows:
                which, first, end = repeated_windows(
                    [r[2] for r in rows], np.array([r[3] for r in rows], np.int64), length
                )
                found += [(*rows[i][:2], low, high) for i, low, high in zip(which.tolist(), first.tolist(), end.tolist())]
            columns = list(zip(*found)) if found else [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["grp", "digest", "low", "high"]
            )

        def close() -> int:
            """Sort the rows of a complete group; the bytes that it adds to the block."""
            if all(r[3] > 1 for r in group):
                whole.extend((*r[:2], 0, len(r[2]) - length + 1) for r in group)
            elif len(group) > 1:
                rows.extend(group)
                return sum(len(r[2]) + 1 for r in group)
            return 0

        for batch in small_batches(batches, "string"):
            for row in zip(*(batch.column(n).to_pylist() for n in ("grp", "digest", "string", "times"))):
                if group and row[0] != group[0][0]:
                    held += close()
                    group.clear()
                    if held > BLOCK_BYTES or len(whole) > WHOLE_ROWS:
                        yield solve()
                        rows.clear()
                        whole.clear()
                        held = 0
                group.append(row)
        close()
        if rows or whole:
            yield solve()

    return repeated


_STRINGS = "grp long, digest long, place int, string binary, times long"


def repeated_places(strings: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """Runs (grp, digest, low, high) of repeated windows in the distinct strings of each group."""
    sizes = strings.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    hot = cut(sizes.filter(F.col("size") > GROUP_STRINGS).select("grp"))
    divide = bool(widths) and not hot.isEmpty()
    small = strings.join(hot, "grp", "left_anti") if divide else strings
    found = (
        small.repartition("grp")
        .sortWithinPartitions("grp")
        .select("grp", "digest", "string", "times")
        .mapInArrow(_repeated(length), "grp long, digest long, low long, high long")
    )
    if not divide:
        return found
    pieces = keep(
        strings.join(hot, "grp", "left_semi").mapInArrow(
            _pieces(length, widths[0]), f"of_grp long, of_digest long, shift long, {_STRINGS}"
        ),
        "pieces",
    )
    inner = pieces.groupBy("grp", "digest").agg(
        F.first("place").alias("place"), F.first("string").alias("string"), F.sum("times").alias("times")
    )
    deeper = repeated_places(keep(inner, "strings"), length, widths[1:])
    back = deeper.join(pieces.select("grp", "digest", "of_grp", "of_digest", "shift"), ["grp", "digest"])
    return found.unionByName(
        back.select(
            F.col("of_grp").alias("grp"),
            F.col("of_digest").alias("digest"),
            (F.col("low") + F.col("shift")).alias("low"),
            (F.col("high") + F.col("shift")).alias("high"),
        )
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _removed(length: int) -> Callable:
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small_batches(batches, "packed"):
            spans, kept = [], []
            for packed, runs in zip(batch.column("packed"), batch.column("runs").to_pylist()):
                data = unpack(packed.as_py())
                merged: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"]) for r in runs or ()):
                    stop = high - 1 + length
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([low, stop])
                at, parts = 0, []
                for low, stop in merged:
                    parts.append(data[at:low])
                    at = stop
                parts.append(data[at:])
                kept.append(b"".join(parts))
                spans.append([{"start": a, "stop": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("id"), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                [ROW, "id", "spans", "kept"],
            )

    return removed


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns _row (place in ``docs``), id, spans (removed bytes: start, stop), kept (binary).

    A byte goes if a ``length``-byte string that covers it also begins anywhere else.
    """
    if not 2 <= length <= 255:
        raise ValueError("length is from 2 to 255")
    spark = docs.sparkSession
    size = max(1, int(length * ANCHOR_SHARE))
    texts = with_row(docs).select(
        ROW,
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    anchors = texts.select(ROW, "text").mapInArrow(
        _anchors(length, size), f"{ROW} long, anchor long, run long"
    )
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    runs = (
        anchors.join(shared.select("anchor"), "anchor")
        .groupBy(ROW)
        .agg(F.collect_list("anchor").alias("anchors"), F.collect_list("run").alias("runs"))
    )
    segments = keep(
        texts.select(ROW, "text")
        .filter(F.octet_length("text") >= length)
        .mapInArrow(_packed, f"{ROW} long, packed binary")
        .join(runs, ROW)
        .mapInArrow(
            _segments(length),
            f"{ROW} long, first long, grp long, digest long, place int, string binary",
        ),
        "segments",
    )
    release(spark)
    strings = keep(
        segments.groupBy("grp", "digest").agg(
            F.first("place").alias("place"),
            F.first("string", ignorenulls=True).alias("string"),
            F.count(F.lit(1)).alias("times"),
        ),
        "strings",
    )
    release(spark)
    places = repeated_places(strings, length, (PIECE_WINDOWS, 1))
    runs_by_row = keep(
        places.join(segments.select(ROW, "first", "grp", "digest"), ["grp", "digest"])
        .groupBy(ROW)
        .agg(
            F.collect_list(
                F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
            ).alias("runs")
        ),
        "runs",
    )
    for done in (segments, strings):
        for folder in {f.rsplit("/", 1)[0] for f in done.inputFiles()[:1]}:
            discard(spark, folder)
    release(spark)
    kinds = f"{ROW} long, id long, spans array<struct<start: long, stop: long>>, kept binary"
    packed = texts.mapInArrow(_packed, f"{ROW} long, id long, packed binary")
    return packed.join(runs_by_row, ROW, "left").mapInArrow(_removed(length), kinds)
