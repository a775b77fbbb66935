import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SCHEMA, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns named like the operators' own, one row given twice, and rows without an id or with a used one."""
    from pyspark.sql import functions as F

    twice = odd.unionAll(odd.filter("doc_id = 3"))
    other = odd.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")).unionAll(odd.filter("doc_id = 7").withColumn("doc_id", F.lit(1).cast("long")))
    made = twice.unionAll(other)
    for c in ("id", "key", "rep", "n", "size", "copies", "component", "line", "cut", "kind", "m", "score", "part", "__id", "own_id", "text__", "__kept", "kept_id", "__copies", "copies_of", "times", "found", "moves", "cut_lines"):
        made = made.withColumn(c, F.lit(c))
    return made


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
