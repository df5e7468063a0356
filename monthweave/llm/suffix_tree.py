"""Language-model scores from a probabilistic suffix tree over bytes.

The symbols are the UTF-8 bytes of the text, A to Z made lower case, and an end. Every
context of up to ``depth`` symbols is counted over the whole corpus. A context is retained if
its next-symbol distribution diverges from that of its suffix one symbol shorter: count times
Kullback-Leibler divergence of at least ``MIN_GAIN`` nats. All of these, with their
suffixes, make the tree. Distributions are smoothed by those of the shorter suffixes, down to
a uniform one. A text is read as a sequence of states, each the longest suffix of what came
before that the tree holds, and every symbol scored in its state.

The most frequent contexts, ``HEAD_CONTEXTS`` at most, are broadcast as an automaton; all others,
the tail, stay a table. A suffix is at least as frequent as its context, so the head
holds all suffixes of its contexts, and a tail context applies only where the one that is one symbol
longer than the head's is in the tail. A bitmap of bounded size finds those places, and
some others besides; a shuffle join of their n-grams with the tail scores them exactly.

Beside it stands a unigram model of words with one added to every count. Words are
counted over the whole corpus; the most frequent, ``HEAD`` at most, are looked up where the text
is read, all others by a shuffle join on their 64-bit hashes.

Cases: null counts as empty and is one end token. Repeated rows are scored each, null
ids carried along. Without training rows, unigram probabilities are one and symbols
uniform. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.llm.storage import ROW, cut, keep, largest, ship_code, with_row
from monthweave.llm.words import U64, mixed, small_batches, text_bytes, word_hashes, word_places

DEPTH = 5
MIN_COUNT = 32
MIN_GAIN = 24.0
#: Contexts of the broadcast automaton, and the most bits of the bitmap of the others.
HEAD_CONTEXTS = 1 << 15
TAIL_BITS = 1 << 27
SMOOTHING = 4.0
HEAD = 1 << 18
#: Distinct n-grams or words a task holds before it adds up.
HELD = 1 << 21
SEGMENT = 256

START, END, SYMBOLS = 0, 257, 258
SYMBOL_BITS = 9
#: Stands for the end of a text among the word hashes.
END_WORD = U64(0x5851F42D4C957F2D)
GRAM, WORD = 0, 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def symbols_of(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array: ``depth`` starts, the bytes plus one, an end; and where each begins."""
    sizes = np.diff(starts) + depth + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begins[-1], np.uint16)
    inner = np.ones(begins[-1], bool)
    inner[(begins[:-1, None] + np.arange(depth)).ravel()] = False
    inner[begins[1:] - 1] = False
    out[inner] = _LOWER[data].astype(np.uint16) + 1
    out[begins[1:] - 1] = END
    return out, begins


def grams(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Codes of each symbol, lowest, with the ``depth`` before it; starts are no symbols."""
    code = np.zeros(max(0, len(symbols) - depth), U64)
    for k in range(depth + 1):
        code |= symbols[depth - k : len(symbols) - k].astype(U64) << U64(SYMBOL_BITS * k)
    return code[symbols[depth:] != START]


class _Tally:
    """Counts of 64-bit keys, added up whenever many are held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > HELD:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
            return keys, counts
        return np.zeros(0, U64), np.zeros(0, np.int64)


def _count(depth: int) -> Callable:
    """Partial counts of n-grams and words, each once a task as far as its memory goes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, texts = (_Tally(), _Tally()), 0

        def emit(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = tallies[kind].total()
            for low in range(0, len(keys), 1 << 16):
                part = keys[low : low + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), kind, np.int8)),
                        pa.array(part),
                        pa.array(counts[low : low + (1 << 16)]),
                    ],
                    ["kind", "key", "n"],
                )

        for batch in small_batches(batches):
            data, starts = text_bytes(batch.column("text"))
            symbols, _ = symbols_of(data, starts, depth)
            tallies[GRAM].add(grams(symbols, depth))
            tallies[WORD].add(word_hashes(data, *word_places(data, starts)))
            texts += batch.num_rows
            for kind in (GRAM, WORD):
                if tallies[kind].held > HELD:  # still so after adding up
                    yield from emit(kind)
                    tallies[kind].__init__()
        if texts:
            tallies[WORD].add(np.repeat(END_WORD, texts))
        for kind in (GRAM, WORD):
            yield from emit(kind)

    return count


@dataclass(frozen=True)
class Tree:
    """Counts of the next symbols of each context, shorter contexts first.

    ``contexts[i]`` is the code of a context of ``lengths[i]`` symbols, the latest
    lowest; its suffixes are contexts too. Rows of ``counts`` are contexts, columns
    ``symbols``.
    """

    depth: int
    contexts: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray


@dataclass(frozen=True)
class Tail:
    """The contexts that the head does not hold, and a bitmap that has at least them."""

    contexts: DataFrame  # length, context, total, seen (map of symbol to count)
    bits: np.ndarray


@dataclass(frozen=True)
class Model:
    tree: Tree  # the most frequent contexts
    tail: Tail | None
    words: DataFrame  # key, c
    head: tuple[np.ndarray, np.ndarray]  # sorted hashes and their counts
    total: int
    distinct: int


def _suffix(code: int, length: int) -> int:
    return code & ((1 << SYMBOL_BITS * length) - 1)


def marks(lengths: np.ndarray, contexts: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each context in a bitmap of ``n_bits``, a power of two."""
    mark = mixed(mixed(contexts.astype(U64)) + lengths.astype(U64))
    return mark & U64(n_bits - 1), (mark >> U64(32)) & U64(n_bits - 1)


def has_marks(bits: np.ndarray, lengths: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    one, two = marks(lengths, contexts, 64 * len(bits))
    found = np.ones(len(contexts), bool)
    for bit in (one, two):
        found &= (bits[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)
    return found


def _bitmap(contexts: DataFrame, count: int) -> np.ndarray:
    """A bitmap of (length, context), its words put together by the executors."""
    n_bits = 1 << 10
    while n_bits < min(TAIL_BITS, 64 * count):
        n_bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = marks(batch.column("length").to_numpy(), batch.column("context").to_numpy(), n_bits)
            bit = np.concatenate(both)
            values = [(bit >> U64(6)).view(np.int64), (U64(1) << (bit & U64(63))).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["word", "bits"])

    found = (
        contexts.select("length", "context")
        .mapInArrow(words, "word long, bits long")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(n_bits // 64, U64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return bits


def grow_tree(grams_counted: DataFrame, depth: int, head_contexts: int) -> tuple[Tree, Tail | None]:
    """Contexts retained by the divergence test, with all their suffixes, in head and tail."""
    spark = grams_counted.sparkSession
    context = F.shiftrightunsigned("key", SYMBOL_BITS)
    spread = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(k).alias("length"),
                    context.bitwiseAND(F.lit((1 << SYMBOL_BITS * k) - 1)).alias("context"),
                )
                for k in range(depth + 1)
            )
        )
    )
    symbol = F.col("key").bitwiseAND((1 << SYMBOL_BITS) - 1)
    nexts = cut(
        grams_counted.select(spread.alias("c"), symbol.alias("symbol"), "n")
        .groupBy("c.length", "c.context", "symbol")
        .agg(F.sum("n").alias("n"))
    )
    totals = nexts.groupBy("length", "context").agg(F.sum("n").alias("total"))
    shorter = nexts.join(totals, ["length", "context"]).select(
        (F.col("length") + 1).alias("length"),
        F.col("context").alias("suffix"),
        "symbol",
        (F.col("n") / F.col("total")).alias("expected"),
    )
    often = totals.filter(F.col("total") >= MIN_COUNT)
    cutoff = F.expr(f"shiftleft(1L, cast((length - 1) * {SYMBOL_BITS} AS int)) - 1")
    gains = (
        nexts.filter("length > 0")
        .join(often, ["length", "context"])
        .withColumn("suffix", F.col("context").bitwiseAND(cutoff))
        .join(shorter, ["length", "suffix", "symbol"])
        .groupBy("length", "context")
        .agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("expected"))).alias("gain"))
        .filter(F.col("gain") >= MIN_GAIN)
    )
    suffixes = F.expr(
        f"transform(sequence(0, length), k -> struct(k AS length, "
        f"context & (shiftleft(1L, k * {SYMBOL_BITS}) - 1) AS context))"
    )
    retained = cut(
        gains.select(F.inline(suffixes)).distinct().join(totals, ["length", "context"])
    )
    often = largest(retained, "total", head_contexts)
    held = {(0, 0)} | {(r.length, r.context) for r in often.collect()}
    named = spark.createDataFrame(sorted(held), "length int, context long")
    found = nexts.join(F.broadcast(named), ["length", "context"]).toArrow().to_pydict()
    contexts = sorted(held)
    place = {c: i for i, c in enumerate(contexts)}
    symbols = np.array(sorted(set(found["symbol"])), np.int64)
    counts = np.zeros((len(contexts), len(symbols)), np.float64)
    rows = [place[c] for c in zip(found["length"], found["context"])]
    counts[rows, np.searchsorted(symbols, found["symbol"])] = found["n"]
    tree = Tree(
        depth,
        np.array([c[1] for c in contexts], np.int64),
        np.array([c[0] for c in contexts], np.int64),
        symbols,
        counts,
    )
    rest = retained.join(F.broadcast(named), ["length", "context"], "left_anti")
    left = rest.count()
    if not left:
        return tree, None
    tail = keep(
        nexts.join(rest, ["length", "context"])
        .groupBy("length", "context", "total")
        .agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("seen")),
        "tail",
    )
    return tree, Tail(tail, _bitmap(tail, left))


def train(
    docs: DataFrame,
    text_column: str = "text",
    depth: int = DEPTH,
    head_contexts: int = HEAD_CONTEXTS,
    head: int = HEAD,
) -> Model:
    """A model of all rows of ``docs``."""
    ship_code(docs.sparkSession)
    counted = keep(
        docs.select(F.col(text_column).alias("text"))
        .mapInArrow(_count(depth), "kind byte, key long, n long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    words = counted.filter(F.col("kind") == WORD).select("key", F.col("n").alias("c"))
    total, distinct = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    often = largest(words, "c", head).toArrow()
    keys = often.column("key").to_numpy().view(U64)
    order = np.argsort(keys)
    return Model(
        *grow_tree(counted.filter(F.col("kind") == GRAM).select("key", "n"), depth, head_contexts),
        words,
        (keys[order], often.column("c").to_numpy()[order]),
        total or 0,
        distinct,
    )


@dataclass(frozen=True)
class Automaton:
    """Next state and log10 probability for each state and symbol class."""

    classes: np.ndarray  # of each symbol
    moves: np.ndarray  # states x classes
    logs: np.ndarray
    matched: np.ndarray  # length of each state's longest suffix in the tree


def automaton(tree: Tree) -> Automaton:
    """States are all parts of the tree's contexts, so that the longest suffix of a state
    and a symbol is again a state; each scores as its longest suffix in the tree."""
    k = len(tree.symbols)
    classes = np.full(SYMBOLS, k + 1, np.int64)  # a symbol that was never seen
    classes[tree.symbols] = np.arange(k)
    classes[START] = k
    chances = np.zeros((len(tree.contexts), k + 2))
    place = {}
    for i, (length, code) in enumerate(zip(tree.lengths.tolist(), tree.contexts.tolist())):
        place[(length, code)] = i
        if length:
            shorter = chances[place[(length - 1, _suffix(code, length - 1))]]
        else:
            shorter = np.full(k + 2, 1 / (SYMBOLS - 1))
        seen = np.append(tree.counts[i], [0, 0])
        chances[i] = (seen + SMOOTHING * shorter) / (seen.sum() + SMOOTHING)
    states = set(place)
    for length, code in place:
        for a in range(length):
            for b in range(a + 1, length + 1):
                states.add((b - a, (code >> SYMBOL_BITS * a) & ((1 << SYMBOL_BITS * (b - a)) - 1)))
    ordered = sorted(states)
    number = {s: i for i, s in enumerate(ordered)}
    scored = np.zeros(len(ordered), np.int64)
    shorter_state = np.zeros(len(ordered), np.int64)
    moves = np.full((len(ordered), k + 2), -1, np.int32)
    moves[0] = 0
    for i, (length, code) in enumerate(ordered):
        if length:
            shorter_state[i] = number[(length - 1, _suffix(code, length - 1))]
            scored[i] = scored[shorter_state[i]]
            symbol = code & ((1 << SYMBOL_BITS) - 1)
            moves[number[(length - 1, code >> SYMBOL_BITS)], classes[symbol]] = i
        if (length, code) in place:
            scored[i] = place[(length, code)]
    lengths = np.array([s[0] for s in ordered])
    for length in range(1, lengths[-1] + 1):
        # A symbol that leads to no longer state does what it does in the next shorter suffix.
        at = np.flatnonzero(lengths == length)
        moves[at] = np.where(moves[at] >= 0, moves[at], moves[shorter_state[at]])
    logs = np.log10(np.maximum(chances, 1e-300))[scored].astype(np.float32)
    logs[:, classes[START]] = 0
    return Automaton(classes, moves, logs, tree.lengths[scored])


def tree_scores(
    machine: Automaton,
    symbols: np.ndarray,
    begins: np.ndarray,
    depth: int,
    before: np.ndarray | None = None,
) -> np.ndarray:
    """Log10 probability of each text; long texts are read in segments that overlap by ``depth``.

    ``before`` takes the state in which each symbol is scored.
    """
    sizes = np.diff(begins) - depth
    counts = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = begins[row] + within * SEGMENT
    length = np.minimum(begins[row + 1] - low, SEGMENT + depth)
    order = np.argsort(-length, kind="stable")
    low, length, row = low[order], length[order], row[order]
    coded = machine.classes[symbols]
    width = machine.moves.shape[1]
    moves, logs = machine.moves.ravel(), machine.logs.ravel()
    state = np.zeros(len(low), np.int64)
    total = np.zeros(len(low))
    reach = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    for t, n in enumerate(reach):
        at = state[:n] * width
        at += coded[low[:n] + t]
        if t >= depth:
            total[:n] += logs.take(at)
            if before is not None:
                before[low[:n] + t] = state[:n]
        state[:n] = moves.take(at)
    return np.bincount(row, total, len(sizes)).astype(float)  # whole numbers if there are no rows


def tail_grams(
    machine: Automaton,
    bits: np.ndarray,
    symbols: np.ndarray,
    begins: np.ndarray,
    before: np.ndarray,
    depth: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram of each symbol that a context of the tail may score."""
    matched = machine.matched[before[depth:]]
    at = np.flatnonzero((matched < depth) & (symbols[depth:] != START))
    longer = (matched[at] + 1).astype(U64)
    context = np.zeros(len(at), U64)
    for k in range(1, depth + 1):
        more = symbols[at + (depth - k)].astype(U64) << U64(SYMBOL_BITS * (k - 1))
        context |= np.where(longer >= k, more, U64(0))
    at = at[has_marks(bits, longer, context)]
    code = np.zeros(len(at), U64)
    for k in range(depth + 1):
        code |= symbols[at + (depth - k)].astype(U64) << U64(SYMBOL_BITS * k)
    return np.searchsorted(begins, at + depth, "right") - 1, code


def _counted(row: np.ndarray, keys: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """The distinct keys of each row, and how many times each occurs, as lists."""
    keys = keys.view(np.int64)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys))).astype(np.int32)
    cuts = pa.array(np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(keys[at])), pa.ListArray.from_arrays(cuts, pa.array(times))


_machines: dict[int, Automaton] = {}


def _machine(sent) -> Automaton:
    """One automaton a worker and tree."""
    if sent.id not in _machines:
        _machines.clear()
        _machines[sent.id] = automaton(sent.value)
    return _machines[sent.id]


def _score(tree, head, bits) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, depth = _machine(tree), tree.value.depth
        known, counts = head.value
        gains = np.log10(counts + 1.0)
        for batch in small_batches(batches):
            data, starts = text_bytes(batch.column("text"))
            symbols, begins = symbols_of(data, starts, depth)
            before = None if bits is None else np.zeros(len(symbols), np.int32)
            scores = tree_scores(machine, symbols, begins, depth, before)
            beyond = np.zeros(0, np.int64), np.zeros(0, U64)
            if bits is not None and batch.num_rows:
                beyond = tail_grams(machine, bits.value, symbols, begins, before, depth)
            first, end = word_places(data, starts)
            words = word_hashes(data, first, end)
            bounds = np.searchsorted(first, starts)
            sizes = np.diff(bounds)
            # The end counts as the last word of each row.
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            hit = known[place] == words if len(known) else np.zeros(len(words), bool)
            sums = np.bincount(row[hit], gains[place[hit]], len(sizes)).astype(float)
            found = np.bincount(row[hit], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW),
                    batch.column("id"),
                    pa.array(sizes + 1),
                    pa.array(found),
                    pa.array(sums),
                    pa.array(scores),
                    *_counted(row[~hit], words[~hit], len(sizes)),
                    *_counted(*beyond, len(sizes)),
                ],
                [
                    *(ROW, "id", "n_tokens", "n_known", "logs", "score"),
                    *("rest", "times", "grams", "gram_times"),
                ],
            )

    return score


def _head_logs(tree) -> Callable:
    """What the head says of n-grams: the length of the context that it uses, and the log10."""

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, depth = _machine(tree), tree.value.depth
        for batch in batches:
            code = batch.column("gram").to_numpy().view(U64)
            state = np.zeros(len(code), np.int64)
            for k in range(depth, -1, -1):
                symbol = machine.classes[(code >> U64(SYMBOL_BITS * k)) & U64((1 << SYMBOL_BITS) - 1)]
                if k:
                    state = machine.moves[state, symbol]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("gram"),
                    pa.array(machine.matched[state].astype(np.int32)),
                    pa.array(machine.logs[state, symbol].astype(float)),
                ],
                ["gram", "matched", "head_log"],
            )

    return logs


def tail_gains(read: DataFrame, tail: DataFrame, tree: _Sent, depth: int) -> DataFrame:
    """By how much the tail changes the score of each row that it changes: _row, gain."""
    beyond = read.select(ROW, F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select(
        ROW, F.col("g.grams").alias("gram"), F.col("g.gram_times").alias("times")
    )
    steps = (
        beyond.select("gram")
        .distinct()
        .mapInArrow(_head_logs(tree), "gram long, matched int, head_log double")
        .select("*", F.explode(F.sequence(F.col("matched") + 1, F.lit(depth))).alias("length"))
        .withColumn(
            "context",
            F.expr(
                f"shiftrightunsigned(gram, {SYMBOL_BITS}) & (shiftleft(1L, length * {SYMBOL_BITS}) - 1)"
            ),
        )
    )
    symbol = F.col("gram").bitwiseAND((1 << SYMBOL_BITS) - 1)
    step = F.struct(
        "length", "total", F.coalesce(F.try_element_at("seen", symbol), F.lit(0)).alias("n")
    )
    smoothed = lambda p, s: (s["n"] + F.lit(SMOOTHING) * p) / (s["total"] + F.lit(SMOOTHING))
    chance = F.aggregate(F.array_sort("chain"), F.pow(F.lit(10.0), F.col("head_log")), smoothed)
    known = (
        steps.join(tail, ["length", "context"])
        .groupBy("gram", "head_log")
        .agg(F.collect_list(step).alias("chain"))
        .select("gram", (F.log10(chance) - F.col("head_log")).alias("more"))
    )
    # A place that only the bitmap took for the tail's finds no context, and keeps the head's score.
    return (
        beyond.join(known, "gram")
        .groupBy(ROW)
        .agg(F.sum(F.col("times") * F.col("more")).alias("gain"))
    )


class _Sent:
    """A broadcast value with a name that tells it from others in a worker."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(value)
        self.id = id(self._sent)

    @property
    def value(self):
        return self._sent.value


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns _row (place in ``docs``), id, n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    tree, tail = _Sent(spark, model.tree), model.tail
    read = keep(
        with_row(docs)
        .select(ROW, F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(
            _score(tree, _Sent(spark, model.head), tail and _Sent(spark, tail.bits)),
            f"{ROW} long, id long, n_tokens long, n_known long, logs double, score double, "
            "rest array<long>, times array<int>, grams array<long>, gram_times array<int>",
        ),
        "scores",
    )
    rare = read.select(ROW, F.explode(F.arrays_zip("rest", "times")).alias("w")).select(
        ROW, F.col("w.rest").alias("key"), F.col("w.times").alias("times")
    )
    end_key = F.lit(int(END_WORD))
    ends = model.words.filter(F.col("key") == end_key).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    end_count = ends.first()[0]
    # The smaller table of counts is joined to the rest; words without a count add nothing.
    looked_up = (
        rare.join(model.words, "key")
        .groupBy(ROW)
        .agg(
            F.sum("times").alias("more_known"),
            F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs"),
        )
    )
    size = float(model.total + model.distinct + 1)
    slim = read.drop("rest", "times", "grams", "gram_times").join(looked_up, ROW, "left")
    score = F.col("score")
    if tail:
        slim = slim.join(tail_gains(read, tail.contexts, tree, model.tree.depth), ROW, "left")
        score = score + F.coalesce("gain", F.lit(0.0))
    return slim.select(
        ROW,
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(end_count > 0))).alias("n_known"),
        (
            F.col("logs")
            + F.coalesce("more_logs", F.lit(0.0))
            + F.log10(F.lit(end_count + 1.0))
            - F.col("n_tokens") * F.log10(F.lit(size))
        ).alias("base_score"),
        score.alias("score"),
    )
