"""The registered queries over their whole tables: their contract's columns, and DuckDB where SQL expresses them."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from helpers import words

from querywright.llm import queries

QUERIES, TWINS = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op2_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op3_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_embedding_near_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op5_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_sentencepiece": {"doc_id", "n_ids", "ids_sha256", "decoded_sha256", "lossless"},
    "op8_toxicity": {"doc_id", "severity", "grade", "toxic"},
    "op9_line_dedup": {"doc_id", "n_lines", "n_removed", "kept_sha256"},
    "op10_pii_surrogates": {"doc_id", "n_entities", "text"},
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {}


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r for r in small.collect()}


def run(name, results, spark, sf_dir):
    if name not in results:
        results[name] = QUERIES[name](spark, sf_dir).collect()
    return results[name]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row_of_the_table(name, results, spark, sf_dir):
    got = run(name, results, spark, sf_dir)
    table, key = ("embeddings", "vec_id") if name.startswith("op4") else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in got) == sorted(ids) and COLUMNS[name] <= set(got[0].__fields__)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_as_duckdb(name, results, spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs = con.sql(TWINS[name])
    got = run(name, results, spark, sf_dir)
    assert sorted(got[0].__fields__) == sorted(theirs.columns)
    assert sorted(tuple(r[c] for c in theirs.columns) for r in got) == sorted(theirs.fetchall())


def test_links_of_embeddings(results, spark, sf_dir):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in run("op4_embedding_near_dedup", results, spark, sf_dir)}
    assert sum(got[i].n_links for i, _ in rows) >= 0.99 * linked.sum() and all(got[i].n_links <= n for (i, _), n in zip(rows, linked.sum(axis=1).tolist(), strict=True))


def test_edits_and_digests(results, spark, sf_dir, texts):
    for r in run("op5_document_fingerprints", results, spark, sf_dir):
        assert r.n_chars == len(texts[r.doc_id].text or "") and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r in run("op7_sentencepiece", results, spark, sf_dir):
        text = texts[r.doc_id].text
        assert r.lossless and r.decoded_sha256 == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
    for r in run("op1_mixing", results, spark, sf_dir):
        assert r.size == len(words(texts[r.doc_id].text)) and r.taken <= 3 * r.size


def test_held_out_languages_and_toxicity(results, spark, sf_dir, texts):
    held = [r for r in run("op6_language_id", results, spark, sf_dir) if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in run("op6_language_id", results, spark, sf_dir))
    told = [r for r in held if texts[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in told) >= 0.95 * len(told) > 20
    toxic = {r.doc_id: r.toxic for r in run("op8_toxicity", results, spark, sf_dir)}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic IS NOT NULL").collect()
    assert sum(toxic[r.doc_id] == bool(r.toxic) for r in labels if r.doc_id in toxic) >= 0.85 * len(labels)


def test_no_detected_entity_is_left(results, spark, sf_dir, texts):
    for r in run("op10_pii_surrogates", results, spark, sf_dir):
        before = texts[r.doc_id].text
        mails = re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", before or "")
        assert not any(m in r.text for m in mails) and (r.n_entities > 0 or r.text == before)
