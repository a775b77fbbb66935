"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the ``k`` smallest 48-bit hashes of a text's distinct shingles, ascending,
as base64 of six bytes each.  Sketches of parts merge by keeping the ``k`` smallest of their union;
from sketches alone one estimates resemblance, containment and the number of distinct shingles.
Fewer than ``k`` hashes mean that the sketch is the whole set and the estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, shingles, slices, words

K = 128
SHINGLE = 5
_BITS = 48


def sketches(column: pa.Array, n: int = SHINGLE, k: int = K) -> list[np.ndarray]:
    """The bottom-k sketch of each text; null and blank texts have an empty one."""
    doc, h = shingles(words(column, lower=True), n)
    first = np.searchsorted(doc, np.arange(len(column) + 1))
    return [np.unique(h[a : min(b, a + k)] >> U(64 - _BITS)) for a, b in zip(first[:-1], first[1:], strict=True)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(U)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike (1), an empty one is unlike any other (0)."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, union[-1], "right")) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**_BITS / float(a[-1] + U(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, both / max(distinct(a, k), 1.0))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, k: int = K) -> DataFrame:
    """``(id_col, fingerprint, distinct_shingles)`` for every row; null texts have an empty fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = sketches(part.column("text"), n, k)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([encode(x) for x in found]), pa.array([distinct(x, k) for x in found])], names=["id", "f", "d"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "id long, f string, d double").toDF(id_col, "fingerprint", "distinct_shingles")


def merged(prints: DataFrame, group_cols: list[str], *, fingerprint_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint a group: the ``k`` smallest of all its hashes.  Spark limits each task's rows before the shuffle."""
    hexed = F.hex(F.unbase64(fingerprint_col))
    each = prints.select(*group_cols, F.explode(F.regexp_extract_all(hexed, F.lit("(.{12})"))).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*group_cols).orderBy("h"))
    kept = each.withColumn("rank", rank).filter(F.col("rank") <= k)
    joined = F.array_join(F.array_sort(F.collect_list("h")), "")
    return kept.groupBy(*group_cols).agg(F.base64(F.unhex(joined)).alias(fingerprint_col))


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """About ``parts - 1`` ids that split the rows evenly; as many values as partitions reach the driver."""
    if parts < 2:
        return []
    asked = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("id", asked, 10000)).first()[0]
    return sorted(set(found or []), reverse=True)


def _part(bounds: list[int]) -> F.Column:
    """How many bounds are above the id, by way of groups of bounds, so that a row meets about two square roots of them."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    above = lambda xs: F.size(F.filter(xs, lambda b: b > F.col("id")))
    coarse = above(F.array(*[F.lit(g[-1]).cast("long") for g in groups]))
    fine = F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups]), coarse)
    return F.least(coarse * width + F.coalesce(above(fine), F.lit(0)), F.lit(len(bounds))).cast("int")


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many (or all)
    of the next document in descending id order; the last is followed by the first.  Null texts count as
    empty; a null id comes after all others; rows that repeat an id are ordered by a hash of their text.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts are shuffled once, dealt to partitions by id range; each partition also gets the first
    document of the one after it.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("real_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(plain, parts)
    dealt = plain.withColumns({"part": _part(bounds), "tie": F.xxhash64("text")})
    heads = sorted(dealt.groupBy("part").agg(F.max(F.struct("id", "tie")).alias("h")).collect())
    ghosts = [(h.h["id"], h.h["tie"], heads[i - 1].part) for i, h in enumerate(heads)]
    if not ghosts:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    first = docs.sparkSession.createDataFrame(ghosts, "id long, tie long, goes int")
    extra = dealt.join(F.broadcast(first), ["id", "tie"]).select("real_id", "id", "text", F.col("goes").alias("part"), "tie", F.lit(1).alias("ghost"))
    rows = dealt.select("real_id", "id", "text", "part", "tie", F.lit(0).alias("ghost")).unionByName(extra)
    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("ghost", F.desc("id"), F.desc("tie"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        over = False
        for part in slices(batches, "text"):
            if over:
                return
            texts, ids, ghost = part.column("text").to_pylist(), part.column("real_id").to_pylist(), part.column("ghost").to_pylist()
            own = sketches(part.column("text"), n, k)
            if True in map(bool, ghost):
                end = ghost.index(1) + 1
                texts, ids, own, over = texts[:end], ids[:end], own[:end], True
            row = list(zip(ids, texts, own, strict=True))
            if held:
                row.insert(0, held)
            held = row[-1]
            pairs = list(zip(row[:-1], row[1:], strict=True))
            if not pairs:
                continue
            edited = []
            for (_, text, _), (_, after, _) in pairs:
                half = len(text) // 2
                edited.append(text[: len(text) - half] + after[:half])
            changed = []
            for piece in slices([pa.RecordBatch.from_arrays([pa.array(edited, pa.large_string())], names=["text"])], "text"):
                changed += sketches(piece.column("text"), n, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([encode(x[2]) for x, _ in pairs]),
                    pa.array([encode(e) for e in changed]),
                    pa.array([resemblance(x[2], e, k) for (x, _), e in zip(pairs, changed, strict=True)]),
                    pa.array([resemblance(x[2], y[2], k) for x, y in pairs]),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    out = placed.select("real_id", "text", "ghost").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
