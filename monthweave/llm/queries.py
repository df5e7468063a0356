"""The registered queries over ``documents`` and ``benchmark``, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthweave.llm import bigru, byte_bpe, pii_crf, suffix_tree, token_alignment
from monthweave.llm.containment import contained_items
from monthweave.llm.exact_dedup import DigestIndex
from monthweave.llm.fingerprints import likeness, with_fingerprint
from monthweave.llm.near_dedup import near_duplicates
from monthweave.llm.next_texts import with_next
from monthweave.llm.periodic_runs import periodic_runs
from monthweave.llm.quality_bayes import score_quality
from monthweave.llm.rendezvous import shard_texts
from monthweave.llm.storage import ROW, keep, shared_folder
from monthweave.llm.suffix_dedup import remove_repeats

SHARDS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex.open(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "item_id", "n_item", "n_shared", "containment"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = new_index(spark).deduplicate(read(spark, sf_dir, "documents"))
    return verdicts.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_texts(read(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def written(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, name), ",")


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii_crf.find_personal_data(docs, pii_crf.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind in pii_crf.KINDS),
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("kept") + gone).alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def vocabulary(
    spark: SparkSession, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> byte_bpe.SharedVocabulary:
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.SharedVocabulary(spark, byte_bpe.read_vocabulary(path, pattern))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    shared = vocabulary(spark, ranks)
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), shared)
    return byte_bpe.decode(encoded, shared).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % divisor


def language_model(docs: DataFrame) -> bigru.Model | None:
    return bigru.fit(docs.filter(remainder("doc_id", 4) != 2))


def op8_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = bigru.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
    )


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"), "evidence", "host_rate", "path_rate", "score", "kept"
    )


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = suffix_tree.train(docs.filter(remainder("doc_id", 7) != 2))
    return suffix_tree.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (remainder("id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


SPACES = r"[\x20\x09-\x0D]+"


def with_loops(docs: DataFrame) -> DataFrame:
    """Columns doc_id and text, with a loop in the texts whose checksum of the id ends in 0.

    From word a on, such a text repeats its words a to a + p - 1.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    named = docs.select("doc_id", "text", F.floor(checksum / 10).alias("g"), F.when(checksum % 10 == 0, words).alias("words"))
    n = F.size("words")
    placed = named.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    placed = placed.withColumn(
        "p", (F.floor((n - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int")
    )
    loop = F.transform(
        F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.get("words", F.col("a") + i % F.col("p"))
    )
    looped = F.array_join(F.concat(F.slice("words", 1, F.col("a")), loop), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_loops(read(spark, sf_dir, "documents")))
    # Runs come by start and period, so the first of those with the greatest exponent stays.
    greater = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = found.withColumn("best", F.aggregate("runs", none, greater))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return best.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(
    spark: SparkSession,
    sf_dir: str,
    a_file: str | None = None,
    b_file: str | None = None,
    head_pairs: int = token_alignment.HEAD,
) -> DataFrame:
    shared = token_alignment.share_tokenizers(
        spark,
        a_file or public_tokenizers.path("byte_bpe_50k.json"),
        b_file or public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )
    number = lambda column: F.size(column).cast("long")
    found = token_alignment.align(read(spark, sf_dir, "documents"), shared)
    aligned = keep(
        found.select(
            ROW,
            F.col("id").alias("doc_id"),
            number("a_ids").alias("n_a"),
            number("b_ids").alias("n_b"),
            number("a_sizes").alias("n_groups"),
            F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
            "pairs",
            "times",
        ),
        "aligned",
    )
    pairs = token_alignment.pair_counts(aligned)
    numbers = token_alignment.link_statistics(aligned, pairs, head_pairs)
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    own = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    return aligned.select(ROW, *own).join(numbers, ROW, "left").select(*own, *counted)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shuffled as bytes, half as long as their digits.
    packed = lambda df: with_fingerprint(df, output="digits").withColumn("about", F.unhex("digits"))
    docs = with_next(read(spark, sf_dir, "documents"), packed)
    digits = lambda name: F.lower(F.hex(name))
    edited = docs.select(
        "id",
        "n_chars",
        digits("about").alias("fingerprint"),
        digits("next_about").alias("next_fingerprint"),
        F.concat("kept", "next_head").alias("edited"),
    )
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_rendezvous_shards": op3_rendezvous_shards,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii_crf": op5_pii_crf,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_bigru_language": op8_bigru_language,
    "op9_quality_bayes": op9_quality_bayes,
    "op10_suffix_tree_scores": op10_suffix_tree_scores,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_document_fingerprints": op13_document_fingerprints,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_ctes(table: str, key: str, name: str) -> str:
    """CTEs ``{name}_words`` (key, words) and ``{name}_sets`` (key, shingle), the latter distinct."""
    return f"""
        {name}_words AS (
          SELECT {key} AS key, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
          FROM {table}),
        {name}_sets AS (
          SELECT DISTINCT key, unnest(CASE
            WHEN len(words) = 0 THEN []
            WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' '))
          END) AS shingle
          FROM {name}_words)"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH {shingle_ctes("documents", "doc_id", "d")}, {shingle_ctes("benchmark", "item_id", "b")},
        sizes AS (SELECT key, count(*) AS n_item FROM b_sets GROUP BY key),
        together AS (
          SELECT d.key AS doc_id, b.key AS item_id, count(*) AS n_shared
          FROM d_sets d JOIN b_sets b USING (shingle) GROUP BY ALL)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
        FROM together JOIN sizes ON key = item_id
        WHERE n_shared >= ceil(0.75 * n_item - 1e-9)
    """,
    "op2_exact_dedup": r"""
        WITH bare AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        best AS (
          SELECT text_sha256, first(doc_id ORDER BY points DESC, doc_id) AS keep_id,
                 count(*) AS group_size
          FROM bare GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM bare JOIN best USING (text_sha256)
    """,
    "op4_minhash_near_dedup": f"""
        WITH RECURSIVE {shingle_ctes("documents", "doc_id", "d")},
        sizes AS (SELECT key, count(*) AS n FROM d_sets GROUP BY key),
        together AS (
          SELECT x.key AS a, y.key AS b, count(*) AS shared
          FROM d_sets x JOIN d_sets y ON x.shingle = y.shingle AND x.key <> y.key
          GROUP BY x.key, y.key),
        links AS (
          SELECT a, b FROM together
          JOIN sizes s ON s.key = a JOIN sizes t ON t.key = b
          WHERE 100 * shared >= 75 * (s.n + t.n - shared)),
        reach(node, seen) AS (
          SELECT key, key FROM d_words
          UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
        least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept
        FROM least LEFT JOIN sizes ON key = node
    """,
}
