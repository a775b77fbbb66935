"""MinHash near-duplicate groups with min-max hashing.

Every permutation gives two signature values, its minimum and its maximum over
the shingle set, so 64 hash evaluations a shingle give 128 values.  Bands of four
values (two permutations) find candidates; a pair at the threshold of 0.8 shares
none of the 32 bands with probability 5e-8.  Candidates are confirmed on full sets.

Equal sets are folded into one representative before banding.  Confirmed links are
gathered in two steps: each representative with the smallest one it shares a band
with; then the members of bands that still hold different components are joined across
components by an exact set-similarity join, rarest shingles first.  A large group of near
copies therefore costs one check a member, texts that share no more than a common line
never meet, and no link that joins two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, components, mix, saved, shingles, signed, slices, words
from .setjoin import candidate_pairs

PERMUTATIONS = 64
BAND_VALUES = 4
_CHUNK = 4096


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (x[:n].astype(np.uint32) | np.uint32(1))[:, None], x[n:].astype(np.uint32)[:, None]


def min_max(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, as ``(permutations, 2)``."""
    x = (h >> U(32)).astype(np.uint32)
    low = high = None
    for k in range(0, len(x), _CHUNK):
        v = x[None, k : k + _CHUNK] * a
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v += b
        lo, hi = v.min(axis=1), v.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.stack([low, high], axis=1)


def _signer(n: int, permutations: int, per_band: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(permutations)
        for batch in slices(batches, "text"):
            doc, h = shingles(words(batch.column("text"), lower=True), n)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            size = np.diff(first)
            some = np.flatnonzero(size)
            values = np.zeros((batch.num_rows, 2 * permutations), np.uint32)
            key = np.zeros((batch.num_rows, 2), U)
            for d in some:
                own = h[first[d] : first[d + 1]]
                values[d] = min_max(own, a, b).ravel()
                key[d] = mix(own).sum(), mix(own ^ U(0xA5A5A5A5A5A5A5A5)).sum()
            grouped = values.astype(U).reshape(batch.num_rows, -1, per_band)
            bands = np.zeros(grouped.shape[:2], U)
            for k in range(per_band):
                bands = mix((bands ^ grouped[:, :, k]) * U(0x9E3779B97F4A7C15) + U(k + 1))
            bands = mix(bands + np.arange(bands.shape[1], dtype=U) * U(0xC2B2AE3D27D4EB4F))
            bands = bands[some].ravel().view(np.int64)
            offsets = np.concatenate([[0], np.cumsum((size > 0) * grouped.shape[1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size.astype(np.int64)), signed(key[:, 0]), signed(key[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands))],
                names=["id", "n_shingles", "k1", "k2", "bands"],
            )

    return sign


def _verifier(n: int, percent: int):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[object, np.ndarray | None] = (None, None)
        for batch in batches:
            for part in slices([batch], "text_b", 2 << 20):
                w = words(part.column("text_b"), lower=True)
                doc, h = shingles(w, n)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                a_ids = part.column("a").to_pylist()
                linked = np.zeros(part.num_rows, bool)
                for k, a in enumerate(a_ids):
                    if known[0] != a:
                        known = (a, shingles(words(part.column("text_a").slice(k, 1), lower=True), n)[1])
                    own = h[first[k] : first[k + 1]]
                    both = len(np.intersect1d(own, known[1], assume_unique=True))
                    linked[k] = 100 * both >= percent * (len(own) + len(known[1]) - both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return verify


def _setter(n: int):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, h = shingles(words(part.column("text"), lower=True), n)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("c"), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), signed(h))],
                names=["id", "c", "n", "hs"],
            )

    return sets


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the full shingle sets of their texts are that similar."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(n, percent), "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, per_band: int = BAND_VALUES) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Links texts whose sets of ``n``-word shingles (A-Z lower-cased) have
    ``100 * intersection >= percent * union``.  A text of fewer words is one shingle; null, empty
    and blank texts have an empty set, link with nothing and keep their own id.  Rows that repeat an
    id belong to one component and are all returned; other columns are not looked at.  Null ids get
    a null component, are ``kept`` and link nothing.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed_docs = saved(plain.mapInArrow(_signer(n, permutations, per_band), "id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    full = signed_docs.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = saved(full.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    member = full.select("id", "k1", "k2", "n_shingles").join(classes.select("k1", "k2", "n_shingles", "rep"), ["k1", "k2", "n_shingles"]).select("id", "rep")

    keys = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).filter("lead < top").select("key", "lead")
    hits = saved(keys.join(shared, "key").select("key", "rep", "lead", "n_shingles"))

    wanted = hits.select(F.col("rep").alias("id")).distinct()
    texts = saved(plain.join(wanted, "id").dropDuplicates(["id"]) if _repeats(signed_docs) else plain.join(wanted, "id"))
    stars = hits.groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("a")).filter("a < b").select("a", "b")
    first = saved(confirmed(stars, texts, n, percent))
    links = first.filter("linked").select("a", "b")
    copies = member.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    part = saved(components(links))
    placed = hits.join(part, hits["rep"] == part["id"], "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    apart = placed.join(mixed, "key").select(F.col("rep").alias("id"), "c").distinct()
    sets = texts.join(apart, "id").select("id", "c", "text").mapInArrow(_setter(n), "id long, c long, n long, hs array<long>")
    tokens = saved(sets).select("id", "c", "n", F.explode("hs").alias("h"))
    rest = candidate_pairs(tokens, percent)
    rest = saved(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    second = saved(confirmed(rest, texts, n, percent).filter("linked").select("a", "b"))
    if second.take(1):
        part = saved(components(links.union(second)))

    ids = member.join(part, member["rep"] == part["id"], "left").select(member["id"].alias("id"), F.coalesce("component", "rep").alias("component"))
    if _repeats(signed_docs):  # rows of one id with different texts join their groups
        part = components(ids.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links).union(second).union(copies))
        ids = ids.select("id").distinct().join(part, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    out = signed_docs.select("id", "n_shingles").join(ids, "id", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _repeats(signed_docs: DataFrame) -> bool:
    one = signed_docs.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return bool(one.take(1))
