"""One thin query per corpus operator, over its whole table; digest columns are derived from the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import twins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    return plan(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import with_edits

    return with_edits(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter("toxic IS NOT NULL").select("doc_id", toxicity.graded().alias("grade")))
    return toxicity.score(docs, model)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicate

    kept = deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import anonymize

    return anonymize(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_substring_dedup, op3_minhash_near_dedup, op4_embedding_near_dedup, op5_document_fingerprints, op6_language_id, op7_sentencepiece, op8_toxicity, op9_line_dedup, op10_pii_surrogates]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others' results rest on keyed hashes, graphs or fitted models."""
    return {"op2_substring_dedup": twins.SUBSTRING_DEDUP, "op3_minhash_near_dedup": twins.NEAR_DEDUP, "op9_line_dedup": twins.LINE_DEDUP}
