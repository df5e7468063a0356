"""Fingerprints of whole texts by one-permutation MinHash, from DataFrame functions only.

A text's shingles are all runs of five of its words (in lower case; words are maximal runs of
characters other than space and 0x09 to 0x0D); a text of fewer words has its whole word
sequence as its one shingle. Each shingle is hashed once. The top bits of the hash name a bin,
and each bin keeps its least hash. An empty bin takes over the least hash of another bin by
optimal densification: it looks at bins in an order drawn for it alone and takes the first that
is not empty, so every filled bin is as likely as any other and all texts look in the same
order. The order is given by ATTEMPTS draws and then by a random priority of all bins, so
it always ends. Only the low-order bits of each bin are stored, as hexadecimal digits.

Two bins of different hashes agree on ``bits`` low-order bits with a chance of 2**-bits; the
likeness takes this share off the share of bins that agree. It estimates the share of the
shingles of two texts that both have (Jaccard), with a standard deviation of at most
0.5 / sqrt(bins).

All steps are projections: no shuffle, no Python. The arrays of a text have as many elements as the
text has words, and a very long text is treated in one row.

Cases: a null, empty or blank text has no shingle and an empty fingerprint; it is like (1.0)
another such text and unlike (0.0) all others. Equal texts have equal fingerprints; repeated rows and null
ids are kept, each with its own. Other columns are not touched, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
BIN_BITS = 8
LOW_BITS = 8
#: Draws that an empty bin makes before it looks at the priorities of all bins.
ATTEMPTS = 16
SPACES = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """Hashes of the shingles of an array of word hashes; empty without words.

    ``words`` is looked up for each shingle, so it should be a column, not an expression.
    """
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)])
    size = F.size(words)
    many = F.transform(F.sequence(F.lit(0), size - SHINGLE_WORDS), run)
    one = F.array(F.xxhash64(words))
    none = F.array().cast("array<bigint>")
    return F.when(size >= SHINGLE_WORDS, many).when(size > 0, one).otherwise(none)


def _bin(value: Column, bin_bits: int) -> Column:
    return F.shiftright(value, 64 - bin_bits)


def with_fingerprint(
    df: DataFrame,
    text_column: str = "text",
    output: str = "fingerprint",
    bin_bits: int = BIN_BITS,
    low_bits: int = LOW_BITS,
) -> DataFrame:
    """Add ``output``: the packed low-order bits of 2**bin_bits bins, ``low_bits`` / 4 hexadecimal digits each.

    Each step is a column of its own, so that none is computed anew for each element of another.
    """
    if low_bits % 4 or not 4 <= low_bits <= 16 or not 1 <= bin_bits <= 12:
        raise ValueError("low_bits is 4, 8, 12 or 16, bin_bits 1 to 12")
    half, rest = 1 << (bin_bits - 1), 64 - bin_bits
    # Bins are numbered from -half to half - 1, the order of signed hashes. The largest hash of
    # a bin stands for an empty one: sorted in, it makes the array of first hashes complete.
    all_bins = F.sequence(F.lit(-half).cast("long"), F.lit(half - 1).cast("long"))
    none = F.transform(all_bins, lambda b: F.shiftleft(b, rest) + F.lit((1 << rest) - 1))
    place = lambda b: (b + half).cast("int")
    is_empty = lambda v: v.bitwiseAND((1 << rest) - 1) == F.lit((1 << rest) - 1)

    steps = df.select(F.struct("*").alias("_all"), word_hashes(F.col(text_column)).alias("_words"))
    steps = steps.select("_all", shingle_hashes(F.col("_words")).alias("_hashes"))
    steps = steps.select("_all", F.sort_array(F.concat("_hashes", none)).alias("_sorted"))
    first = lambda v, i: (i == 0) | (
        _bin(v, bin_bits) != _bin(F.get("_sorted", F.greatest(i - 1, F.lit(0))), bin_bits)
    )
    steps = steps.select("_all", F.filter("_sorted", first).alias("_bins"))
    full = F.transform(F.filter("_bins", lambda v: ~is_empty(v)), lambda v: place(_bin(v, bin_bits)))
    steps = steps.select("_all", "_bins", full.alias("_full"))

    def drawn(i: Column, attempt: int) -> Column:
        return F.get("_bins", place(_bin(F.xxhash64(i, F.lit(attempt)), bin_bits)))

    def preferred(i: Column) -> Column:
        # A priority has the bin's place in its lowest bits.
        by_priority = F.transform(
            "_full",
            lambda b: F.xxhash64(i, b).bitwiseAND(F.lit(-2 * half).cast("long")).bitwiseOR(b.cast("long")),
        )
        return F.get("_bins", F.array_min(by_priority).bitwiseAND(2 * half - 1).cast("int"))

    def filled(value: Column, i: Column) -> Column:
        choices = reduce(
            lambda c, j: c.when(~is_empty(drawn(i, j)), drawn(i, j)),
            range(ATTEMPTS),
            F.when(~is_empty(value), value),
        )
        return choices.otherwise(preferred(i))

    digits = low_bits // 4
    low = lambda v: F.lpad(F.hex(v.bitwiseAND((1 << low_bits) - 1)), digits, "0")
    complete = F.when(F.size("_full") == 2 * half, F.col("_bins")).otherwise(F.transform("_bins", filled))
    steps = steps.select("_all", F.when(F.size("_full") > 0, complete).alias("_filled"))
    packed = F.coalesce(F.lower(F.array_join(F.transform("_filled", low), "")), F.lit(""))
    return steps.select("_all", packed.alias("_packed")).select("_all.*", F.col("_packed").alias(output))


def likeness(a: Column, b: Column, bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS) -> Column:
    """Estimated share of common shingles of the texts of two fingerprints, 0 to 1."""
    bins = lambda f: F.regexp_extract_all(f, F.lit("." * (low_bits // 4)), F.lit(0))
    same = F.zip_with(bins(a), bins(b), lambda x, y: (x == y).cast("int"))
    share = F.aggregate(same, F.lit(0), lambda n, s: n + s) / F.lit(float(1 << bin_bits))
    chance = 2.0**-low_bits
    clear = F.greatest((share - F.lit(chance)) / F.lit(1 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(clear)
