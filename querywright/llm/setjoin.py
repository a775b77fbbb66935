"""Exact set-similarity join: rarest tokens first, with prefix, positional and length filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b)


def probe_prefix(n: Column, percent: int) -> Column:
    """How many of a set's rarest tokens must meet any partner that is not larger."""
    return n - _ceil(n * percent, 100) + 1


def index_prefix(n: Column, percent: int) -> Column:
    """How many of a set's rarest tokens must meet any partner that is not smaller."""
    return n - _ceil(n * (2 * percent), 100 + percent) + 1


def candidate_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, that hold every pair of sets with Jaccard likeness of ``percent`` or more.

    ``tokens`` has a row ``(id, n, h)`` for each distinct token ``h`` of set ``id`` of ``n`` tokens, and any
    column ``c``: pairs of equal ``c`` are left out.  Tokens are ordered by how many sets hold them, so a
    token that many sets share stands in few prefixes; tokens of one set alone match nothing and only take up places.
    """
    held = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(held, "h")
    per_set = Window.partitionBy("id")
    placed = shared.withColumns({"among": F.row_number().over(per_set.orderBy("df", "h")), "known": F.count("*").over(per_set)})
    placed = placed.withColumn("r", F.col("among") + F.col("n") - F.col("known")).filter(F.col("r") <= probe_prefix(F.col("n"), percent))
    x = placed.filter(F.col("r") <= index_prefix(F.col("n"), percent)).alias("x")
    y = placed.alias("y")
    need = _ceil((F.col("x.n") + F.col("y.n")) * percent, 100 + percent)
    most = F.least(F.col("x.n") - F.col("x.r"), F.col("y.n") - F.col("y.r")) + 1
    found = x.join(
        y,
        (F.col("x.h") == F.col("y.h"))
        & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id"))
        & (F.col("x.c") != F.col("y.c"))
        & (F.col("x.n") * 100 >= F.col("y.n") * percent)
        & (most >= need),
    )
    return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
