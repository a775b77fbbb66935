"""Shared pieces of the corpus operators: word arrays, hashes, cut points, components.

Text is handled in Arrow batches with numpy inside Spark tasks: a batch of texts
becomes one byte array, its words become 64-bit values, and everything after
that is array arithmetic.  Words are the runs of bytes other than
``\\x20 \\x09-\\x0D``; since those are ASCII, byte-wise splitting is exact for UTF-8.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import work_folder

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_WORD = 64
#: The low k bytes of a 64-bit value.
_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage, survives lost executors.

    Spark is told to remove the shuffle files of the write when it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, so that Python workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


@dataclass
class Words:
    """The words of a batch of texts.

    ``data`` bytes of all texts; ``start``/``size`` byte spans of words; ``doc`` the text of
    each word; ``first`` offsets of the texts' words (one more than texts); ``hash`` a 64-bit value a word;
    ``bounds`` the bytes at which texts begin, and the end.
    """

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _spans(column: pa.Array, lower: bool, breaks: np.ndarray) -> tuple[np.ndarray, ...]:
    offsets = text_offsets(column)
    base, end = int(offsets[0]), int(offsets[-1])
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[base:end] if buffer is not None and end > base else np.zeros(0, np.uint8)
    if lower:
        data = np.take(_LOWER, data)
    bounds = offsets - base
    if not len(data):
        return data, bounds, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.take(~breaks, data)
    turns = np.empty(len(data) + 1, bool)
    turns[0], turns[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=turns[1:-1])
    edges = np.flatnonzero(turns)
    cut = np.unique(bounds[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut - 1] & inside[cut]]  # one text ends and the next begins inside a run
    if len(cut):
        edges = np.insert(edges, np.repeat(np.searchsorted(edges, cut), 2), np.repeat(cut, 2))
    start = edges[0::2]
    return data, bounds, start, edges[1::2] - start


def words(column: pa.Array, *, lower: bool = False, seed: int = 0) -> Words:
    """Splits and hashes; null texts have no words."""
    if column.null_count:
        column = column.fill_null("")
    data, bounds, start, size = _spans(column, lower, _SPACE)
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, start, size, doc, first, hash_spans(data, start, size, seed), bounds)


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; eight bytes of all spans are taken in at a time."""
    first = U(0x9E3779B97F4A7C15 ^ (seed * 0x2545F4914F6CDD1D & (2**64 - 1)))
    if not len(start):
        return np.zeros(0, U)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    x = eight[start]
    x &= _BYTES[np.minimum(size, 8)]
    x ^= first
    x *= U(0xFF51AFD7ED558CCD)
    x += size.astype(U)
    out = mix(x)
    live = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    taken = 8
    while len(live):
        left = size[live] - taken
        x = eight[start[live] + taken] & _BYTES[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ x) * U(0xFF51AFD7ED558CCD) + left.astype(U))
        taken += 8
        live = live[left > 8]
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = U(xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]].tobytes(), seed))
    return out


def chain(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive values of ``h`` (fewer values: an empty array)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    state = 0x9E3779B97F4A7C15 + 2 * seed
    for k in range(n):
        state = (state * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1)
        out += h[k : k + m] * U(state | 1)
    return mix(out ^ U(seed))


def windows(w: Words, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each ``n``-word window that stays inside one text."""
    h = chain(w.hash, n, seed)
    at = np.arange(len(h))
    keep = w.doc[at] == w.doc[at + n - 1] if len(h) else np.zeros(0, bool)
    return h[keep], w.doc[at[keep]], at[keep]


def shingles(w: Words, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the distinct ``n``-word shingles, by text; a text of fewer words is one shingle as a whole."""
    h, doc, _ = windows(w, n, seed)
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        whole = np.array([chain(w.hash[w.first[d] : w.first[d + 1]], int(w.counts[d]), seed + 101)[0] for d in few], U)
        at = np.searchsorted(doc, few)
        h, doc = np.insert(h, at, whole), np.insert(doc, at, few)
    ends = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(h)], strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every id in an edge list; component is the smallest id reachable.

    Alternates large-star and small-star rounds, so a chain of any length takes about log rounds.
    Each round is a written table; nothing is collected but two counters.  Null and self edges are left out.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = saved(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        links = pairs.select("a", "b")
        if large:
            links = links.union(pairs.select(F.col("b"), F.col("a")))
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        joined = links.join(low, "a").select("a", "b", F.least("a", "low").alias("low"))
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = joined.select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("p"))
        return out.select(F.col("p.b").alias("a"), F.col("p.low").alias("b"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        for large in (True, False):
            pairs = star(pairs, large).filter("a <> b").distinct()
        pairs = saved(pairs)
        now = state(pairs)
        if now == before:
            break
        before = now
    return pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    ).groupBy("id").agg(F.min("component").alias("component"))
