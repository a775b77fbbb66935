"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm import langid, lines, minhash, mixing, pieces
from querywright.llm.common import unused
from querywright.tables import work_folder


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or with a narrow margin between languages go; labels are learned from the input's own."""
    model = langid.fit(docs)
    kept = langid.predict(docs, model, keep=tuple(c for c in docs.columns if c != "text"), with_text=True)
    return kept.filter("accepted").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that repeat an earlier one go; ``n_chars`` follows the text."""
    cut = lines.deduplicate(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles: of every group the document with the smallest id stays."""
    own = unused(docs, "kept_id")
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").take(1):  # of rows that repeat an id one stays
        left = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id IS NULL"))
    return left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding with merge-dropout; the ids decode to the text."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", cut_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No SQL expresses compression, keyed hashing or merge agendas; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
