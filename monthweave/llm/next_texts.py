"""Each text beside the one that follows it by id, from DataFrame functions only.

Documents are in the order of descending ids; the last is followed by the first. Only ids and
hashes are sorted, by a range of them in each task; what comes after the last of a task's rows is
read off one row for each task. The texts then meet their neighbours in two shuffle joins, one of
which moves whole texts and the other no more than a half of each.

Cases: null ids come last. Rows that differ in their text alone follow each other in the order of a
hash of it. Rows equal in id and text count as one document and are shuffled as one; each of them gets the
result, so a frequent row fills no task. A null text counts as empty. Other columns are ignored.
A single document is followed by itself. An empty table gives no rows. A very long text is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthweave.llm.storage import keep, release

KEY = ["_key", "_tie"]
#: Bits below the number of the task in ``monotonically_increasing_id``.
TASK_BITS = 33


def named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Columns _key and _tie (never null, equal for rows equal in id and text), id, text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    name = F.concat(F.lit("="), F.col(id_column).cast("string"))
    return docs.select(
        F.coalesce(name, F.lit("")).alias("_key"),
        F.xxhash64(text).alias("_tie"),
        F.col(id_column).alias("id"),
        text.alias("text"),
    )


def followers(rows: DataFrame) -> DataFrame:
    """Columns _key, _tie, next_key, next_tie, half: each document and the one that follows it.

    ``half`` is half the document's number of code points, rounded down.
    """
    slim = rows.groupBy(*KEY, "id").agg(F.max(F.floor(F.length("text") / 2)).alias("half"))
    placed = keep(
        slim.orderBy(F.desc_nulls_last("id"), "_tie").select(
            *KEY, "half", F.monotonically_increasing_id().alias("_place")
        ),
        "places",
    )
    tasks = placed.groupBy(F.shiftright("_place", TASK_BITS).alias("task")).agg(
        F.min("_place").alias("first"), F.max("_place").alias("last")
    )
    # One row for each task that wrote places, so small beside any of them.
    ends = tasks.select(
        F.col("last").alias("_place"),
        F.coalesce(F.lead("first").over(W.orderBy("task")), F.min("first").over(W.partitionBy())).alias("_first"),
    )
    after = placed.join(F.broadcast(ends), "_place", "left").select(
        *KEY, "half", F.coalesce("_first", F.col("_place") + 1).alias("_place")
    )
    nexts = placed.select(
        F.col("_key").alias("next_key"), F.col("_tie").alias("next_tie"), "_place"
    )
    return after.join(nexts, "_place").drop("_place")


def _heads(rows: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Columns _key, _tie, about, before_key, before_tie, next_head, one row for each document: what the
    document before it needs of it. Written."""
    # Equal rows are put together before and after the shuffle.
    texts = rows.groupBy(*KEY).agg(F.any_value("text").alias("text"))
    asked = followers(rows).select(
        F.col("next_key").alias("_key"),
        F.col("next_tie").alias("_tie"),
        F.col("_key").alias("before_key"),
        F.col("_tie").alias("before_tie"),
        "half",
    )
    head = F.substring("text", F.lit(1), F.col("half").cast("int")).alias("next_head")
    return keep(
        describe(texts.join(asked, KEY)).select(*KEY, "before_key", "before_tie", "about", head),
        "next-heads",
    )


def with_next(
    docs: DataFrame,
    describe: Callable[[DataFrame], DataFrame],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Columns id, n_chars, kept, next_head, about, next_about; one row for each row of ``docs``.

    ``kept`` is the text without its last floor(n_chars / 2) code points, and ``next_head`` has the
    first as many (or all) of the next text. ``describe`` adds a column ``about`` to rows with a
    whole ``text``; each text's is found once.
    """
    rows = named(docs, id_column, text_column)
    heads = _heads(rows, describe)
    # The whole texts' shuffle files can go before the halves are shuffled.
    release(docs.sparkSession)
    own = heads.select(*KEY, "about")
    following = heads.select(
        F.col("before_key").alias("_key"),
        F.col("before_tie").alias("_tie"),
        "next_head",
        F.col("about").alias("next_about"),
    )
    size = F.length("text")
    halves = rows.select(
        *KEY,
        "id",
        size.cast("long").alias("n_chars"),
        F.substring("text", F.lit(1), (size - F.floor(size / 2)).cast("int")).alias("kept"),
    )
    one = halves.groupBy(*KEY, "id", "n_chars").agg(F.any_value("kept").alias("kept"), F.count(F.lit(1)).alias("_rows"))
    whole = one.join(following, KEY).join(own, KEY)
    return whole.select(
        "id", "n_chars", "kept", "next_head", "about", "next_about",
        F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"),
    ).drop("_copy")
