"""A corpus cleaned stage by stage; every stage's rows are written and read again.

Each stage takes and returns the columns of ``documents``; the last returns the tokens.
Not expressible in SQL as a whole, so ``ORACLE_SQL`` is None.

Cases: rows with a null or letterless text go in the first stage. Repeated rows, ids
included, become one. Null ids are carried along. Further columns are carried to the
last stage, which drops them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.llm import bigru, byte_bpe, queries
from monthweave.llm.containment import contained_items
from monthweave.llm.near_dedup import near_duplicates
from monthweave.llm.storage import keep, without_rows

#: A text whose best language has less probability than this is in none of them.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a recognisable language go.

    Without any labelled text nothing is recognised, and only letterless texts go.
    """
    model = queries.language_model(docs)
    if model is None:
        return docs.filter(bigru.has_letter(F.col("text")))
    # Columns of the documents may have the names of the result.
    numbered = docs.toDF(*(f"column{i}" for i in range(len(docs.columns))))
    found = bigru.identify(numbered, model, f"column{docs.columns.index('text')}")
    clear = (F.col("lang_pred") != bigru.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(clear).select(*numbered.columns).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    index = queries.new_index(spark)
    kept = index.kept_rows(docs)
    # Nothing can open this index again, and the later stages need the disk.
    index.drop()
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays."""
    return without_rows(docs, near_duplicates(docs).filter(~F.col("stays")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go."""
    found = contained_items(docs, queries.read(spark, sf_dir, "benchmark"))
    return without_rows(docs, found.select("_row").distinct())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns doc_id, n_tokens, ids (little-endian unsigned 32-bit), text (decoded again).

    The ids are written before they are decoded. In one plan every task would hold a Python worker
    for each of the two steps, and executors keep those, grown to the largest step, through all later stages.
    """
    shared = queries.vocabulary(spark)
    encoded = keep(byte_bpe.encode(docs, shared), "ids")
    decoded = byte_bpe.decode(encoded, shared)
    return decoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.decode("decoded", "UTF-8").alias("text"),
    )


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
