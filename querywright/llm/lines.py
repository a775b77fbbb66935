"""Line dedup by an exact set-similarity join.

A line is its set of distinct words (A-Z lower-cased).  Words are ordered by how rare they are; a
pair of lines with the wanted Jaccard likeness must share a word within short prefixes of both, at places
that leave room for enough common words, have similar lengths, and parities of their words (64 or 128 bits) no further apart than
words may differ.  Of the pairs that pass those filters, the one that shares most prefix words is verified first for
every line; where that fails, the others are, those that a longer parity (at least a bit a word) leaves possible.

The order only has to be the same everywhere, so rarity is a table of fixed size: counts over all lines,
by hash cell.  Equal sets are folded before the join, so the join's rows are distinct sets and a
line that millions of documents repeat is one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, mix, saved, signed, slices, unused, words

PERCENT = 80
CELL_BITS = 21
_CHUNK_BITS = 14
#: Rows that are held at once.
HELD = 1 << 17
#: Partners of a line that one word emits, and places that rows of a word are compared over, before the rows beyond count as crowded.
MOST = 16
REACH = HELD
#: Rows with more partners in reach than SPAN are compared in tiles of so many rows and others; DEEP likely partners of a row a tile are looked at.
SPAN, TILE, ACROSS, DEEP = 32, 64, 4096, 64
#: Rows of a crowded word that meet in one task: those that ask, and those that are asked.
ASKING, ASKED = 1024, 16384
_LOW = U((1 << 56) - 1)


def _lines(column: pa.Array, rarity: np.ndarray | None):
    """Distinct words of every line with words: ``(text, line number, offsets, tokens)``, rarest first."""
    w = words(column, lower=True)
    return _split(w, rarity)


def _split(w, rarity: np.ndarray | None):
    if not len(w.hash):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(1, np.int64), np.zeros(0, U)
    newline = np.flatnonzero(w.data == 10)
    breaks = np.unique(np.concatenate([w.first[:-1], np.searchsorted(w.start, newline)]))
    head = breaks[breaks < len(w.hash)]  # the first word of each line that has words
    ends = np.append(head[1:], len(w.hash))
    doc = w.doc[head]
    begin = w.bounds[doc]
    number = np.searchsorted(newline, w.start[head]) - np.searchsorted(newline, begin)
    token = w.hash >> U(8)
    if rarity is not None:
        token |= rarity[(token >> U(56 - CELL_BITS)).astype(np.int64)].astype(U) << U(56)
    for a, b in zip(head.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            token[a:b].sort()
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    fresh[head] = True
    first = np.concatenate([[0], np.cumsum(fresh)])[np.append(head, len(token))]
    return doc, number, first, token[fresh]


def _keys(first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each set."""
    t = token & _LOW
    if len(first) < 2:
        return np.zeros(0, U), np.zeros(0, U)
    return np.add.reduceat(mix(t), first[:-1]), np.add.reduceat(mix(t ^ U(0x5BD1E995A5A5A5A5)), first[:-1])


def _parities(first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, values)``: the words' parity of each set, in 64 bits for up to 64 words, in 128 for up to 128 and so on to 1024.

    The halves of a longer parity, folded, are the next shorter one.
    """
    n = np.diff(first)
    width = np.minimum(1 << np.ceil(np.log2(np.maximum(n / 64, 1))).astype(np.int64), 16)
    offsets = np.concatenate([[0], np.cumsum(width)])
    h = mix((token & _LOW) + U(9))
    owner = np.repeat(np.arange(len(n)), n)
    values = np.zeros(int(offsets[-1]), U)
    np.bitwise_xor.at(values, offsets[owner] + ((h >> U(48)).astype(np.int64) & (width[owner] - 1)), U(1) << (h >> U(58)))
    return offsets, values


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line's names and place (lines of one set once a slice, further places in lists), and at the end the word counts by cell."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for part in slices(batches, "text"):
        w = words(part.column("text"), lower=True)
        if not len(w.hash):
            continue
        counts += np.bincount((w.hash >> U(64 - CELL_BITS)).astype(np.int64), minlength=len(counts))
        doc, number, first, token = _split(w, None)
        one, two = _keys(first, token)
        ids = part.column("id").to_numpy()[doc]
        order = np.lexsort((number, ids, two, one))
        one, two, ids, number = one[order], two[order], ids[order], number[order].astype(np.int32)
        head = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        size = np.diff(np.append(head, len(one))) - 1
        further = np.ones(len(one), bool)
        further[head] = False
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [signed(one[head]), signed(two[head]), pa.array(ids[head]), pa.array(number[head]), pa.ListArray.from_arrays(offsets, pa.array(ids[further])), pa.ListArray.from_arrays(offsets, pa.array(number[further])), pa.nulls(len(head), pa.int32()), pa.nulls(len(head), pa.binary())],
            names=_DESCRIBED_NAMES,
        )
    if counts.any():
        each, kind = 1 << _CHUNK_BITS, "<u4" if counts.max() < 1 << 32 else "<u8"
        found = [(k, counts[k * each : (k + 1) * each].astype(kind).tobytes()) for k in range(len(counts) // each)]
        none = [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names=_DESCRIBED_NAMES)


_DESCRIBED = "k1 long, k2 long, id long, line int, ids array<long>, lines array<int>, chunk int, counts binary"
_DESCRIBED_NAMES = ["k1", "k2", "id", "line", "ids", "lines", "chunk", "counts"]


def _vector(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if len(blob) == 4 << _CHUNK_BITS else "<u8").astype(np.int64)


def _total(table: pa.Table) -> np.ndarray:
    total = np.zeros(1 << _CHUNK_BITS, np.int64)
    for batch in table.to_batches():
        for blob in batch.column("counts"):
            total += _vector(blob.as_py())
    return total


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_total(table).astype("<u8").tobytes()], pa.binary())})


def _levels(key: tuple, table: pa.Table) -> pa.Table:
    level = np.minimum(255, 8 * np.log2(np.maximum(_total(table), 1))).astype(np.uint8)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


def rarity_table(described: DataFrame, *, at_once: int = 256) -> np.ndarray:
    """How often the words of each hash cell occur in all texts, as 8 log2 of the count (0: once at most); of fixed size.

    Counts of many tasks are summed in two steps, about ``at_once`` of them at a time.
    """
    counts = described.filter("chunk IS NOT NULL").select("chunk", "counts")
    groups = -(-counts.filter("chunk = 0").count() // at_once)
    if groups > 1:
        counts = counts.groupBy("chunk", F.pmod(F.xxhash64("counts"), F.lit(groups)).alias("part")).applyInArrow(_summed, "chunk int, counts binary")
    table = np.zeros(1 << CELL_BITS, np.uint8)
    for r in counts.groupBy("chunk").applyInArrow(_levels, "chunk int, levels binary").collect():
        table[r.chunk << _CHUNK_BITS : (r.chunk + 1) << _CHUNK_BITS] = np.frombuffer(r.levels, np.uint8)
    return table


def _ceil(a, b: int):
    return -((-a) // b)


def _poster(shipped: Broadcast, percent: int):
    """Prefix words of the lines, each distinct line once a slice: by the first place it stands at."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shipped.value
        for part in slices(batches, "text"):
            doc, number, first, token = _lines(part.column("text"), rarity)
            if not len(doc):
                continue
            one, _ = _keys(first, token)
            ids = part.column("id").to_numpy()[doc]
            order = np.lexsort((number, ids, one))
            pick = order[np.flatnonzero(np.concatenate([[True], one[order][1:] != one[order][:-1]]))]
            n = np.diff(first)[pick]
            reach = n - _ceil(n * percent, 100) + 1
            line = np.repeat(np.arange(len(pick)), reach)
            r = np.arange(len(line)) - np.repeat(np.cumsum(reach) - reach, reach)
            t = token[first[pick][line] + r]
            known = t > _LOW  # a word that occurs once matches nothing
            line, r, t = line[known], r[known], t[known]
            own = pick[line]
            h = mix((token & _LOW) + U(9))
            bit = U(1) << (h >> U(58))
            second = ((h >> U(48)) & U(1)).astype(bool) & np.repeat(np.diff(first) > 64, np.diff(first))  # longer lines have 128 bits
            parity, more = (np.bitwise_xor.reduceat(np.where(use, bit, U(0)), first[:-1]) for use in (~second, second))
            word = (t & U(0xFFFFFFFF)).astype(np.int64) << 32 | n[line]
            place = number[own].astype(np.int64) << 32 | (r + 1)
            yield pa.RecordBatch.from_arrays([pa.array(word), signed(one[own]), signed(parity[own]), signed(more[own]), pa.array(ids[own]), pa.array(place)], names=_POSTED_NAMES)

    return post


#: A posted row: the word (32 bits) with the line's number of words; the set's name and parity (the second 64 bits are for more than 64 words); document; line number with the word's place.
_POSTED = "word long, k1 long, parity long, more long, id long, place long"
_POSTED_NAMES = ["word", "k1", "parity", "more", "id", "place"]
_MET = _POSTED + ", oid long, oline int"


class _Rows:
    """Posted rows as arrays."""

    def __init__(self, table: pa.Table):
        word, self.k1, parity, more, self.id, place = (table.column(k).to_numpy() for k in _POSTED_NAMES)
        self.t, self.n = word >> 32, word & 0xFFFFFFFF
        self.line, self.r = place >> 32, place & 0xFFFFFFFF
        self.parity, self.more = parity.view(U), more.view(U)

    def may(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows those that can belong to alike lines by their places and parities, the later line first."""
        need = _ceil((self.n[a] + self.n[b]) * percent, 100 + percent)
        good = np.minimum(self.n[a] - self.r[a], self.n[b] - self.r[b]) + 1 >= need
        one, two = self.parity[a] ^ self.parity[b], self.more[a] ^ self.more[b]
        wide = np.minimum(self.n[a], self.n[b]) > 64
        apart = np.where(wide, np.bitwise_count(one) + np.bitwise_count(two), np.bitwise_count(one ^ two))
        good &= apart <= self.n[a] + self.n[b] - 2 * need
        a, b = a[good], b[good]
        late = (self.id[a] > self.id[b]) | ((self.id[a] == self.id[b]) & (self.line[a] > self.line[b]))
        return np.where(late, a, b), np.where(late, b, a)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*none, pa.array(self.id[a]), pa.array(self.line[a] << 32), pa.array(self.id[b]), pa.array(self.line[b].astype(np.int32))], names=[*_POSTED_NAMES, "oid", "oline"])


def _short_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """The prefix in which a line must meet any partner of at least its length."""
    return n - _ceil(n * 2 * percent, 100 + percent) + 1


def _place_among(a: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(a, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]])) if len(a) else order
    place = np.empty(len(a), np.int64)
    place[order] = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
    return place


def _meeter(percent: int, most: int, reach: int):
    """Joins rows sorted by (word, k1, id, place) with the rows of the same word: pairs (id, line, oid, oline), the later line first.

    A row is compared with those after it until lines become too long for it, but over ``reach`` places at most, and a
    line returns at most ``most`` earlier partners a word.  Both rows of a pair that this holds back are
    returned too, without ``oid`` and with an ``oline`` that is 1 where the row is to ask the others; of a word with rows
    out of reach all are.
    """

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, released = 0, None
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD:
                continue
            table = pa.Table.from_batches(held)
            t = table.column("word").to_numpy() >> 32
            cut = int(np.searchsorted(t, t[-1]))  # the last word may go on in the next batch
            if cut:
                yield from found(table.slice(0, cut), released)
                table = table.slice(cut)
            if len(table) >= HELD:  # one word alone: its rows are let go as crowded
                released = t[-1]
                yield from crowd(table.slice(0, len(table) - 1), np.ones(len(table) - 1, bool))
                table = table.slice(len(table) - 1)
            held, rows = table.to_batches(), len(table)
        if rows:
            yield from found(pa.Table.from_batches(held), released)

    def crowd(table: pa.Table, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.append_column("oid", pa.nulls(len(table), pa.int64())).append_column("oline", pa.array(asks.astype(np.int32)))
        yield from table.combine_chunks().to_batches()

    def found(table: pa.Table, released: int | None) -> Iterator[pa.RecordBatch]:
        word, k1 = table.column("word").to_numpy(), table.column("k1").to_numpy()
        fresh = np.concatenate([[True], (word[1:] != word[:-1]) | (k1[1:] != k1[:-1])])
        if not fresh.all():
            table, word = table.filter(pa.array(fresh)), word[fresh]
        c = _Rows(table)
        kept = c.t == released if released is not None else np.zeros(len(c.t), bool)
        asks, met = kept.copy(), np.zeros(len(c.t), np.int64)

        def some(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = c.may(a, b, percent)
            use = met[a] + _place_among(a) < most
            np.add.at(met, a, 1)
            asks[a[~use]] = kept[a[~use]] = kept[b[~use]] = True
            if use.any():
                yield c.pairs(a[use], b[use])

        def tile(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            wide = c.n[rows[0]] > 64
            sides = (c.parity, c.more) if wide else (c.parity ^ c.more,)  # folded, the parities of longer lines are no further apart
            for at in range(rows[0] + 1, ends[-1], ACROSS):
                to = min(at + ACROSS, ends[-1])
                apart = sum(np.bitwise_count(x[rows][:, None] ^ x[at:to]) for x in sides)
                room = (c.n[rows[-1]] + c.n[at:to]) * (100 - percent) // (100 + percent)
                i, b = np.nonzero(apart <= np.minimum(room, 255).astype(np.uint8))
                b += at
                good = (b > rows[i]) & (b < ends[i])
                i, b = i[good], b[good]
                deep = _place_among(i) >= DEEP
                for x in (rows[i[deep]], b[deep]):
                    asks[x] = kept[x] = True
                yield from some(rows[i[~deep]], b[~deep])

        here = np.flatnonzero(c.r <= _short_prefix(c.n, percent))
        ends = np.searchsorted(word, c.t[here] << 32 | c.n[here] * 100 // percent, "right")
        far = np.isin(c.t, c.t[here[ends - here > reach + 1]])
        kept |= far
        asks |= far
        ends = np.minimum(ends, here + reach + 1)
        near = ends - here <= SPAN + 1
        rows, to = here[near], ends[near]
        for step in range(1, SPAN + 1):
            left = rows + step < to
            rows, to = rows[left], to[left]
            if not len(rows):
                break
            yield from some(rows, rows + step)
        rows, to = here[~near], ends[~near]
        cuts = np.append(np.flatnonzero(_place_among(c.t[rows]) % TILE == 0), len(rows))
        for k, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield from tile(rows[k:end], to[k:end])
        if kept.any():
            yield from crowd(table.filter(pa.array(kept)), asks[kept])

    return meet


def _cell(percent: int):
    """The lines that ask (``asks``) in one cell of a crowded word and are alike to an earlier one of its other rows, judged on their word sets."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        c = _Rows(table)
        sets = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~asks)
        found = []
        for own in np.flatnonzero(asks).tolist():
            late = (c.id[rest] < c.id[own]) | ((c.id[rest] == c.id[own]) & (c.line[rest] < c.line[own]))
            other = rest[late]
            short, long = np.minimum(c.n[other], c.n[own]), np.maximum(c.n[other], c.n[own])
            other = other[short * 100 >= long * percent]
            _, other = c.may(np.full(len(other), own), other, percent)
            for k in range(0, len(other), 64):
                some = [sets[j] for j in other[k : k + 64].tolist()]
                n = np.array([len(x) for x in some])
                common = np.add.reduceat(np.isin(np.concatenate(some), sets[own]).astype(np.int64), np.cumsum(n) - n)
                if (common * 100 >= (n + len(sets[own]) - common) * percent).any():
                    found.append(own)
                    break
        return pa.table({"id": pa.array(c.id[found], pa.int64()), "line": pa.array(c.line[found].astype(np.int32), pa.int32())})

    return meet


def _likeness(percent: int):
    """Whether the word sets of two lines, as sorted 64-bit values, are alike."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                sides = [part.column(name) for name in ("tokens_a", "tokens_b")]
                sizes = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]).astype(np.int64) // 8 for c in sides]
                starts = [int(np.frombuffer(c.buffers()[1], np.int32)[c.offset]) // 8 for c in sides]
                values = [np.frombuffer(c.buffers()[2], "<u8", int(n.sum()), 8 * a) if n.sum() else np.zeros(0, U) for c, n, a in zip(sides, sizes, starts, strict=True)]
                pair = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in sizes])
                key = mix(np.concatenate(values)) ^ mix(pair.astype(U) + U(1))
                order = np.argsort(key)
                key, pair = key[order], pair[order]
                twice = (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][twice], minlength=part.num_rows)
                alike = common * 100 >= (sizes[0] + sizes[1] - common) * percent
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("line")], names=["id", "line"]).filter(pa.array(alike))

    return check


def _weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of line texts the words, as sorted distinct 64-bit values, their number and their parity."""
    for part in slices(batches, "s"):
        w = words(part.column("s"), lower=True)
        order = np.lexsort((w.hash, w.doc))
        doc, token = w.doc[order], w.hash[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        doc, token = doc[fresh], token[fresh]
        first = np.searchsorted(doc, np.arange(part.num_rows + 1))
        offsets, values = _parities(first, token >> U(8))
        tokens = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(token))])
        parity = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("line"), tokens, pa.array(np.diff(first).astype(np.int32)), parity], names=["id", "line", "tokens", "n", "parity"])


def _line_sets(lines: DataFrame, plain: DataFrame) -> DataFrame:
    """``(id, line, tokens, n, parity)`` of the wanted lines (id, line)."""
    wanted = lines.groupBy("id").agg(F.collect_set("line").alias("want"))
    each = plain.join(wanted, "id").select("id", "want", F.split("text", "\n", -1).alias("all")).withColumn("line", F.explode("want"))
    each = each.select("id", "line", F.get("all", F.col("line")).alias("s")).filter("s IS NOT NULL")
    return saved(each.mapInArrow(_weigh, "id long, line int, tokens binary, n int, parity binary"))


def _both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (id, line, oid, oline) with columns of both lines, suffixed ``_a`` and ``_b``."""
    side = lambda a, b, end: sets.select(F.col("id").alias(a), F.col("line").alias(b), *[F.col(c).alias(f"{c}{end}") for c in columns])  # noqa: E731  (alike, so one exchange serves both)
    return pairs.select("id", "line", "oid", "oline").join(side("oid", "oline", "_b"), ["oid", "oline"]).join(side("id", "line", "_a"), ["id", "line"])


def _possible(percent: int):
    """Whether the parities of two lines' words leave room for the wanted likeness."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            na, nb = (part.column(k).to_numpy().astype(np.int64) for k in ("n_a", "n_b"))
            apart = np.zeros(part.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(part.column("parity_a").to_pylist(), part.column("parity_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                while len(x) != len(y):
                    x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
                apart[k] = np.bitwise_count(x ^ y).sum()
            good = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (apart <= na + nb - 2 * _ceil((na + nb) * percent, 100 + percent))
            yield pa.RecordBatch.from_arrays([part.column(k) for k in ("id", "line", "oid", "oline")], names=["id", "line", "oid", "oline"]).filter(pa.array(good))

    return check


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(id, line)`` of the pairs (id, line, oid, oline) whose full word sets are alike."""
    both = _both(pairs, sets, ["tokens"]).select("id", "line", "tokens_a", "tokens_b")
    return both.mapInArrow(_likeness(percent), "id long, line int").distinct()


def _among(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``_verified``, of pairs most of which are not alike."""
    both = _both(pairs, sets, ["n", "parity"]).select("id", "line", "oid", "oline", "n_a", "n_b", "parity_a", "parity_b")
    return _verified(both.mapInArrow(_possible(percent), "id long, line int, oid long, oline int"), sets, percent)


def _alike_to_earlier(plain: DataFrame, rarity: np.ndarray, percent: int, most: int, reach: int) -> DataFrame:
    """``(id, line)`` of distinct lines, by their first place, that an earlier line is alike to."""
    spark = plain.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    post = _poster(spark.sparkContext.broadcast(rarity), percent)
    posted = plain.mapInArrow(post, _POSTED).repartition(parts, F.shiftright("word", 32)).sortWithinPartitions("word", "k1", "id", "place")
    met = saved(posted.mapInArrow(_meeter(percent, most, reach), _MET)).withColumn("line", F.shiftright("place", 32).cast("int"))
    crowd = met.filter("oid IS NULL").select(*_POSTED_NAMES, "line", F.col("oline").alias("to_ask"))
    pairs = met.filter("oid IS NOT NULL AND (id <> oid OR line <> oline)").groupBy("id", "line", "oid", "oline").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("id", "line").orderBy(F.desc("shared"), "oid", "oline")
    pairs = saved(pairs.withColumn("nth", F.row_number().over(best)))
    wanted = pairs.select("id", "line").union(pairs.select("oid", "oline")).union(crowd.select("id", "line"))
    sets = _line_sets(wanted.distinct(), plain)

    # The likeliest partner of each line is verified first; only where it fails come the others.
    alike = saved(_verified(pairs.filter("nth = 1"), sets, percent))
    others = pairs.filter("nth > 1").select("id", "line", "oid", "oline").join(alike, ["id", "line"], "left_anti")
    alike = saved(alike.union(_among(others, sets, percent)))

    # Lines of crowded words that are to ask and still without a partner are compared with all rows returned for those words, cell by cell.
    asking = saved(crowd.filter("to_ask = 1").join(alike, ["id", "line"], "left_anti"))
    if asking.take(1):
        crowd, asking = (x.withColumn("t", F.shiftright("word", 32)) for x in (crowd, asking))
        sizes = asking.groupBy("t").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("blocks"))
        sizes = saved(sizes.join(crowd.groupBy("t").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares")), "t"))
        block = lambda n: F.pmod(F.xxhash64("id", "line"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = sets.select("id", "line", "tokens")
        columns = ["t", *_POSTED_NAMES, "tokens"]
        asks = asking.join(sizes, "t").join(own, ["id", "line"]).select(*columns, block("blocks").alias("block"), every("shares").alias("share"), F.lit(True).alias("asks"))
        asked = crowd.join(sizes, "t").join(own, ["id", "line"]).select(*columns, every("blocks").alias("block"), block("shares").alias("share"), F.lit(False).alias("asks"))
        more = asks.unionByName(asked).groupBy("t", "block", "share").applyInArrow(_cell(percent), "id long, line int")
        alike = saved(alike.union(more).distinct())
    return alike


def near_duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, most: int = MOST, reach: int = REACH) -> DataFrame:
    """``(id, cut)``: for every document that loses lines, their numbers from 0.

    A line goes when an earlier one, by (id, line number), has a word set of that Jaccard likeness; lines
    are judged on the input.  Lines without words never go and match nothing.  Rows with a null
    id take no part; rows that repeat an id count as one document whose lines compare by number.
    ``most`` and ``reach`` bound what is looked at first; no result depends on them.
    """
    plain = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    described = saved(plain.mapInArrow(_describe, _DESCRIBED))
    alike = _alike_to_earlier(plain, rarity_table(described), percent, most, reach)
    lines = described.filter("chunk IS NULL").select("k1", "k2", F.struct("id", "line").alias("at"), "ids", "lines")
    classes = lines.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.sum(1 + F.size("ids")).alias("n")).filter("n > 1").select("k1", "k2", "first")
    again = lines.join(classes, ["k1", "k2"]).select("first", F.explode(F.array_append(F.arrays_zip(F.col("ids").alias("id"), F.col("lines").alias("line")), F.col("at"))).alias("at"))
    again = again.filter("at > first").select("at.id", "at.line")
    return again.union(alike).groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("cut"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with repeated lines cut from ``text_col``, and ``n_lines`` and ``n_removed`` added.

    Kept lines stay as they are and in order, joined by a newline; a text that loses no line is
    unchanged, one that loses all is empty, a null stays null with 0 lines.  Rows with a null id are unchanged.
    Columns of ``docs`` named ``n_lines`` or ``n_removed`` are replaced; any other name may occur.
    """
    plain = docs.drop("n_lines", "n_removed")
    own, lost = unused(plain, "own_id"), unused(plain, "cut_lines")
    cut = near_duplicate_lines(docs, id_col=id_col, text_col=text_col, percent=percent).select(F.col("id").alias(own), F.col("cut").alias(lost))
    text = F.col(f"`{text_col}`")
    joined = plain.join(cut, plain[id_col].cast("long") == F.col(own), "left")
    count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    out = joined.withColumn("n_lines", F.coalesce(count, F.lit(0)).cast("long"))
    removed = F.when(F.col(lost).isNull() | text.isNull(), 0).otherwise(F.size(F.filter(lost, lambda i: i < F.col("n_lines"))))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(lost, i)), "\n")
    out = out.withColumn("n_removed", removed.cast("long"))
    return out.withColumn(text_col, F.when(F.col(lost).isNull(), text).otherwise(kept)).drop(own, lost)
