"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

``P(grade <= k) = sigmoid(threshold[k] - w . x)``: one weight vector is shared by all ordered
thresholds.  Features are hashed words (ASCII punctuation and digits cut, A-Z lower-cased) and their
leading 5 to 8 bytes, as present or absent.  Weights get an L1 penalty, so that a long text is not
judged by the sum of thousands of small ones.  The expected severity is ``sum over k of P(grade > k)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, _spans, hash_spans, mix, saved, slices

BITS = 20
PREFIXES = (5, 6, 7, 8)
SAMPLE_ROWS = 8000
MIN_DOCS = 4
MIN_Z = 4.5
STEPS = 2000
L1 = 0.0001
CUT = 0.3
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = True
_BREAKS[65:91] = _BREAKS[97:123] = False


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of the distinct hashed features of each text, by text."""
    data, bounds, start, size = _spans(column.fill_null("") if column.null_count else column, True, _BREAKS)
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(column)), np.diff(first)).astype(U)
    found = [hash_spans(data, start, size)]
    docs = [doc]
    for k in PREFIXES:
        long = size >= k
        found.append(hash_spans(data, start[long], np.full(int(long.sum()), k), seed=k))
        docs.append(doc[long])
    key = np.concatenate(docs) << U(32) | mix(np.concatenate(found)) >> U(64 - bits)
    order = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(docs).astype(np.int64), minlength=len(column)))])
    place = np.argsort(np.concatenate(docs), kind="stable")
    key = key[place]
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        key[a:b].sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    return (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Ordinal:
    """Non-zero weights by ascending feature, and the ordered thresholds."""

    feature: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def score(self, doc: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.feature, feature), max(len(self.feature) - 1, 0))
        hit = self.feature[at] == feature if len(self.feature) else np.zeros(len(feature), bool)
        return np.bincount(doc[hit], weights=self.weight[at[hit]], minlength=rows)

    def above(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for every text and threshold."""
        return 1 / (1 + np.exp(np.clip(self.threshold[None, :] - score[:, None], -50, 50)))


def _telling(one: Column, both: Column, above: int, below: int, min_docs: int, min_z: float) -> Column:
    """Whether a feature is held by enough documents and its share among graded and ungraded ones differs beyond chance."""
    share = both / (above + below)
    spread = F.sqrt(F.greatest(share * (1 - share) * (1 / above + 1 / below), F.lit(1e-12)))
    return (both >= min_docs) & (F.abs(one / above - (both - one) / below) >= min_z * spread)


def train(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, *, steps: int = STEPS, l1: float = L1) -> Ordinal:
    """Maximum likelihood with an L1 penalty, by proximal AdaGrad over the whole sample."""
    levels = max(1, int(grade.max(initial=1)))
    used, col = np.unique(feature, return_inverse=True)
    n = len(grade)
    share = np.array([(np.sum(grade <= k) + 1) / (n + 2) for k in range(levels)])
    threshold = np.log(share / (1 - share))
    w, gw, gt = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(levels, 1e-8)
    rows = np.arange(n)
    heft = np.full(n, 1 / max(n, 1))
    for _ in range(steps if n else 0):
        s = np.bincount(doc, weights=w[col], minlength=n)
        edge = np.concatenate([[-np.inf], threshold, [np.inf]])
        hi, lo = (1 / (1 + np.exp(np.clip(s - edge[grade + 1], -50, 50))), 1 / (1 + np.exp(np.clip(s - edge[grade], -50, 50))))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        grad = np.bincount(col, weights=((dhi - dlo) * heft)[doc], minlength=len(used))
        gw += grad * grad
        rate = 0.3 / np.sqrt(gw)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        step = np.zeros(levels + 2)
        np.add.at(step, grade[rows] + 1, -dhi * heft)
        np.add.at(step, grade[rows], dlo * heft)
        gt += step[1:-1] ** 2
        threshold = np.maximum.accumulate(threshold - 0.3 / np.sqrt(gt) * step[1:-1])
    some = np.flatnonzero(w)
    return Ordinal(used[some], w[some], threshold)


def graded(*, toxic_col: str = "toxic", quality_col: str = "quality") -> Column:
    """Severity from two binary labels, the only ones that the table has: 0 not toxic, 1 toxic in a text of quality, 2 toxic in a poor text."""
    return F.when(F.col(toxic_col) == 1, F.when(F.col(quality_col) == 0, 2).otherwise(1)).otherwise(0)


def fit(docs: DataFrame, grades: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = SAMPLE_ROWS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, bits: int = BITS) -> Ordinal:
    """Learns from at most ``sample_rows`` labelled documents, those with the smallest hash of their id (so grades keep their shares).

    Only features held by ``min_docs`` of them, and more or less often among graded ones by ``min_z`` standard errors, are used.  Where
    all have one grade, or there are none, no feature is, and every text with features gets the sample's (smoothed) shares.
    """
    marked = grades.filter(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(grade_col).cast("int")).alias("grade"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, feature = features(part.column("text"), bits)
            offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))], names=["id", "grade", "features"])

    sample = saved(plain.join(F.broadcast(chosen), "id").select("id", "grade", "text").mapInArrow(run, "id long, grade int, features array<int>"))
    above, below = sample.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") == 0)).first()
    if not above or not below:
        grade = np.array([r.grade for r in sample.select("grade").collect()], np.int64)
        return train(np.zeros(0, np.int64), np.zeros(0, np.int64), grade)
    # Only features that tell grades apart reach the driver: at most 2**bits of them, and of a document so many at most.
    each = sample.select("grade", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count_if(F.col("grade") > 0).alias("one"), F.count("*").alias("both"))
    telling = np.sort(np.array([r.feature for r in counts.filter(_telling(F.col("one"), F.col("both"), above, below, min_docs, min_z)).select("feature").collect()], np.int64))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("features")
            flat = lists.flatten().to_numpy()
            hit = np.isin(flat, telling)
            offsets = np.concatenate([[0], np.cumsum(hit)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[hit]))], names=["id", "grade", "features"])

    found = sample.mapInArrow(keep, sample.schema).toArrow().combine_chunks().sort_by("id")
    lists = found.column("features").combine_chunks()
    count = np.diff(lists.offsets.to_numpy())
    return train(np.repeat(np.arange(len(found)), count), lists.flatten().to_numpy().astype(np.int64), found.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Ordinal, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, bits: int = BITS) -> DataFrame:
    """``(id_col, severity, grade, toxic)`` for every row.

    ``severity`` is the expected grade, ``grade`` the largest k with P(grade >= k) of ``cut`` or more, and
    ``toxic`` whether it is above 0.  Null, empty and blank texts have severity 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, feature = features(part.column("text"), bits)
            above = model.above(model.score(doc, feature, part.num_rows))
            above[np.bincount(doc, minlength=part.num_rows) == 0] = 0
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(above.sum(axis=1)), pa.array((above >= cut).sum(axis=1).astype(np.int32))], names=["id", "severity", "grade"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(run, f"id {kind}, severity double, grade int")
    return out.select(F.col("id").alias(id_col), "severity", "grade", (F.col("grade") > 0).alias("toxic"))
