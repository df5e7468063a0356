"""Registered queries against their SQL twins, and the shape of what they return."""

from __future__ import annotations

import pytest

from check_oracle import duckdb_rows, duckdb_tables, normalised
from monthweave.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_rendezvous_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_pii_crf": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_bigru_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_quality_bayes": {"doc_id": "bigint", "score": "double", "kept": "boolean"},
    "op10_suffix_tree_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op12_token_alignment": {**dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"},
    "op13_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(FOLDER)


def test_all_operators():
    assert set(queries.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns, rows = duckdb_rows(con, queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(columns)
    assert normalised(df.columns, df.collect()) == normalised(columns, rows)


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - {"op1_decontamination"}))
def test_one_row_a_document(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids) == [r.doc_id for r in queries.read(spark, FOLDER, "documents").orderBy("doc_id").collect()]


def test_digests_of_the_spans(spark):
    import hashlib

    for r in queries.op5_pii_crf(spark, FOLDER).filter("n_added = 0").collect():
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
