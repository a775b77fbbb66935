"""Removal of repeated word passages, found by recompression.

A text is a sequence of word symbols.  A recompression round first names runs (equal neighbours become
one symbol, named by symbol and length), then names pairs: every symbol has a keyed coin, and a 0-symbol
followed by a 1-symbol become one.  Names are hashes of what they stand for, so they are the same
everywhere without an exchange, and whether a symbol arises at a place depends on a few words around it only.  Hence equal
passages consist of equal symbols but for their ends:

* two names of a whole text's words fold equal texts into one class;
* inside every window of ``n`` words the smallest symbol (with the words that decide it) that lies in the
  window is its anchor, the same in every occurrence; a window without one is its own anchor;
* anchors that texts of different classes share, found by one sorted exchange, reveal candidate windows;
* those are compared, in a second exchange, by two 64-bit names of their word sequences, from two independent hashes of every word.

One round is taken: symbols of later ones are decided by more words than a short window holds.
An anchor serves about five windows, so the corpus-wide exchange carries a row for about five words,
and only windows behind a shared anchor are exchanged one by one (those of one slice of texts folded beforehand).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Words, chain, hash_spans, mix, saved, signed, slices, words

WINDOW = 13
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 2**64)
_EDGE = -(1 << 40)


def recompress(symbol: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``rounds`` of naming runs and pairs: symbol, text, and the span of words ``low:high`` that decides it.

    At an end of a text ``low`` is below, ``high`` above every word: such a symbol is not decided by words alone.
    """
    low = np.arange(len(symbol), dtype=np.int64)
    high = low + 1
    for k in range(rounds):
        for pairs in (False, True):
            if len(symbol) < 2:
                break
            same = doc[1:] == doc[:-1]
            if pairs:
                coin = (mix(symbol ^ U(0xC0FFEE + k)) >> U(63)).astype(bool)
                joined = same & ~coin[:-1] & coin[1:]
            else:
                joined = same & (symbol[1:] == symbol[:-1])
            head = np.flatnonzero(np.concatenate([[True], ~joined]))
            tail = np.concatenate([head[1:], [len(symbol)]]) - 1
            length = tail - head + 1
            if pairs:
                named = mix(symbol[head] * U(0xBF58476D1CE4E5B9) + symbol[tail] * U(0x94D049BB133111EB) + U(k))
            else:
                named = mix(symbol[head] * U(0xD1B54A32D192ED03) + length.astype(U))
            left = np.maximum(head - 1, 0)
            right = np.minimum(tail + 1, len(symbol) - 1)
            low, high = (
                np.where((head > 0) & (doc[left] == doc[head]), low[left], _EDGE),
                np.where((tail + 1 < len(symbol)) & (doc[right] == doc[tail]), high[right], -_EDGE),
            )
            symbol, doc = np.where(length > 1, named, symbol[head]), doc[head]
    return symbol, doc, low, high


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``values[a:b]`` for each of many short ranges."""
    width = int((b - a).max(initial=1))
    levels = [values]
    while (1 << len(levels)) <= width:
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    out = np.empty(len(a), values.dtype)
    span = np.maximum(b - a, 1)
    power = np.floor(np.log2(span)).astype(np.int64)
    for p in range(len(levels)):
        at = np.flatnonzero(power == p)
        if len(at):
            out[at] = np.minimum(levels[p][a[at]], levels[p][b[at] - (1 << p)])
    return out


def anchors(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and anchor of each ``n``-word window."""
    at = np.arange(max(0, len(w.hash) - n + 1))
    at = at[w.doc[at] == w.doc[at + n - 1]]
    if not len(at):
        return at, at, np.zeros(0, U)
    _, doc, low, high = recompress(w.hash, w.doc, 1)
    decided = (low >= 0) & (high <= len(w.hash)) & (high - low <= n)
    low, high = low[decided], high[decided]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(w.hash), _B, dtype=U)]))
        back = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(w.hash), _B_INVERSE, dtype=U)]))
    total = np.concatenate([np.zeros(1, U), np.cumsum(w.hash * power[:-1])])
    name = mix((total[high] - total[low]) * back[low] + (high - low).astype(U) * U(0xD1B54A32D192ED03))
    a = np.searchsorted(low, at, "left")
    b = np.searchsorted(high, at + n, "right")
    found = chain(w.hash, n, 3)[at]
    some = np.flatnonzero(b > a)
    if len(some):
        found[some] = _least(name, a[some], b[some])
    return at, w.doc[at], found


def _class(w: Words) -> np.ndarray:
    """Two 64-bit names of each text's whole word sequence."""
    with np.errstate(over="ignore"):
        step = [np.cumprod(np.full(int(w.counts.max(initial=1)), b, dtype=U)) for b in (_B, 0xD1342543DE82EF95)]
    out = np.zeros((len(w.counts), 2), U)
    for d in np.flatnonzero(w.counts):
        own = w.hash[w.first[d] : w.first[d + 1]]
        for k in (0, 1):
            out[d, k] = (mix(own + U(k)) * step[k][: len(own)]).sum()
    return mix(out ^ w.counts.astype(U)[:, None])


def _plain(part: pa.RecordBatch) -> list[list[bytes]]:
    """The words of each text as bytes: ``bytes.split`` cuts at the same six characters."""
    return [t.encode().split() for t in part.column("text").to_pylist()]


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        w = words(part.column("text"))
        key = _class(w)
        digest = [hashlib.sha256(b" ".join(t)).hexdigest() for t in _plain(part)]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(w.counts), signed(key[:, 0]), signed(key[:, 1]), pa.array(digest, pa.string())], names=["id", "n_words", "k1", "k2", "whole"])


def _anchor_rows(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            _, doc, found = anchors(w, n)
            if not len(doc):
                continue
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            doc, found = doc[fresh], found[fresh]
            name = _class(w)[:, 0][doc]
            order = np.lexsort((name, found))
            found, name = found[order], name[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (name[1:] != name[:-1])
            yield pa.RecordBatch.from_arrays([signed(found[fresh]), signed(name[fresh])], names=["anchor", "k1"])

    return run


def _window_rows(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in map(_own, slices(batches, "text")):
            w = words(part.column("text"))
            at, doc, found = anchors(w, n)
            lists = part.column("anchors")
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            take = np.zeros(len(at), bool)
            for d in range(part.num_rows):
                shared = lists[d].values.to_numpy(zero_copy_only=False).view(U)
                take[first[d] : first[d + 1]] = np.isin(found[first[d] : first[d + 1]], shared)
            rows = at[take]
            if not len(rows):
                continue
            one, two = chain(w.hash, n, 5)[rows], chain(hash_spans(w.data, w.start, w.size, 77), n, 7)[rows]
            ids = part.column("id").to_numpy()[doc[take]]
            place = rows - w.first[doc[take]] + (part.column("slot").to_numpy().astype(np.int64) << 32)[doc[take]]
            # Of a window that many texts of this slice hold, only the smallest id is in doubt; the
            # others are cut whatever other slices hold: they have no h2, and an h1 that spreads them.
            order = np.lexsort((place, ids, two, one))
            one, two, ids, place = one[order], two[order], ids[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            low = ids[head][np.repeat(np.arange(len(head)), np.diff(np.append(head, len(ids))))]
            doubt, sure = np.flatnonzero(ids == low), np.flatnonzero(ids != low)
            yield pa.RecordBatch.from_arrays([signed(one[doubt]), signed(two[doubt]), pa.array(ids[doubt]), pa.array(place[doubt])], names=["h1", "h2", "id", "at"])
            if len(sure):
                sure = sure[np.lexsort((place[sure], ids[sure]))]
                yield pa.RecordBatch.from_arrays([signed(mix(ids[sure].view(U))), pa.nulls(len(sure), pa.int64()), pa.array(ids[sure]), pa.array(place[sure])], names=["h1", "h2", "id", "at"])

    return run


def _rest(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in map(_own, slices(batches, "text")):
            w = words(part.column("text"))
            cover = np.zeros(len(w.hash) + 1, np.int32)
            lists, slot = part.column("cut"), part.column("slot").to_pylist()
            for d in range(part.num_rows):
                starts = np.unique(lists[d].values.to_numpy(zero_copy_only=False))
                starts = (starts[starts >> 32 == slot[d]] & 0xFFFFFFFF) + w.first[d]
                cover[starts] += 1
                np.subtract.at(cover, starts + n, 1)
            keep = np.cumsum(cover[:-1]) == 0
            texts = [b" ".join(compress(t, keep[w.first[d] : w.first[d + 1]].tolist())) for d, t in enumerate(_plain(part))]
            removed = w.counts - np.array([keep[w.first[d] : w.first[d + 1]].sum() for d in range(part.num_rows)], np.int64)
            digest = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(removed), pa.array(digest), pa.array([t.decode() for t in texts])], names=["k1", "k2", "n_removed", "digest", "kept_text"])

    return run


def _classes(base: DataFrame, n: int) -> DataFrame:
    """Each word sequence of ``n`` words or more with the smallest id that has it; ``slot`` tells apart texts of one id."""
    first = base.filter("id IS NOT NULL").filter(F.col("n_words") >= n).groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    return first.withColumn("slot", F.row_number().over(Window.partitionBy("rep").orderBy("k1", "k2")) - 1)


def _sorted_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key, *order)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, k1) those whose anchor more than one text has, each once; a row is held at a time."""
    last: pa.RecordBatch | None = None
    joined = False  # whether the row held shares its anchor with an earlier one
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([last, batch]) if last is not None else batch
        anchor, k1 = rows.column("anchor").to_numpy(), rows.column("k1").to_numpy()
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (k1[1:] != k1[:-1])])
        at = np.flatnonzero(new)
        same = anchor[at][1:] == anchor[at][:-1]
        before, after = np.concatenate([[joined], same]), np.concatenate([same, [False]])
        out = at[:-1][(before | after)[:-1]]
        if len(out):
            yield rows.take(pa.array(out))
        last, joined = rows.slice(int(at[-1]), 1), bool(before[-1])
    if last is not None and joined:
        yield last


def _candidates(plain: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """One text a class, with those of its anchors that other classes have too."""
    found = plain.filter("id IS NOT NULL").mapInArrow(_anchor_rows(n), "anchor long, k1 long")
    shared = _sorted_by(found, "anchor", "k1").mapInArrow(_shared, "anchor long, k1 long")
    held = shared.groupBy("k1").agg(F.collect_list("anchor").alias("anchors"))
    held = classes.join(held, "k1").select(F.col("rep").alias("id"), "k1", "k2", "slot", "anchors")
    return plain.join(held, "id").select("id", "k1", "k2", "slot", "text", "anchors")


def _own(part: pa.RecordBatch) -> pa.RecordBatch:
    """Without rows that pair a text with the class of another text of its id."""
    key = _class(words(part.column("text")))[:, 0]
    same = key.view(np.int64) == part.column("k1").to_numpy()
    return part if same.all() else part.filter(pa.array(same))


_WINDOWS = "h1 long, h2 long, id long, at long"


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of window rows sorted by (h1, h2, id) those that a smaller id has too, and those already decided."""
    key, low = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sure = batch.column("h2").is_null().to_numpy(zero_copy_only=False)
        one, two, ids = (batch.column(k).fill_null(0).to_numpy() for k in ("h1", "h2", "id"))
        turns = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (sure[1:] != sure[:-1])
        head = np.concatenate([[(one[0], two[0], sure[0]) != key], turns])
        first = np.concatenate([[low], ids[head]])[np.cumsum(head)]
        key, low = (one[-1], two[-1], sure[-1]), first[-1]
        out = pa.array(np.flatnonzero((ids > first) | sure))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(out), batch.column("at").take(out)], names=["id", "at"])


def _cut(rows: DataFrame) -> DataFrame:
    """The windows of each id that a smaller id has too."""
    return _sorted_by(rows, "h1", "h2", "id").mapInArrow(_later, "id long, at long").groupBy("id").agg(F.collect_list("at").alias("cut"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256)`` for every row, and ``kept_text`` where asked for.

    Removes each word covered by a window of ``n`` words whose word sequence also starts in a row with a
    smaller id; windows are judged on the input.  Kept words are joined by one space.  Null, empty and
    blank texts have no words; texts of fewer than ``n`` words lose none; rows that repeat an id never cut
    each other; a row with a null id loses nothing and cuts nothing.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = saved(plain.mapInArrow(_describe, "id long, n_words long, k1 long, k2 long, whole string"))
    classes = saved(_classes(base, n))
    texts = saved(_candidates(plain, classes, n))
    cut = saved(_cut(texts.mapInArrow(_window_rows(n), _WINDOWS)))
    part = texts.select("id", "k1", "k2", "slot", "text").join(cut, "id").mapInArrow(_rest(n), "k1 long, k2 long, n_removed long, digest string, kept_text string")
    part = part if with_text else part.drop("kept_text")
    part = saved(part.dropDuplicates(["k1", "k2"]))

    out = base.join(classes, ["k1", "k2"], "left").join(part, ["k1", "k2"], "left")
    copy = F.col("id") > F.col("rep")
    columns = [
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(F.col("id").isNull(), F.col("whole")).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)
