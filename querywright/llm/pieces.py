"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merge-type (BPE) segmentation works through an agenda of candidate merges, best score first.  With
dropout every candidate that comes up is skipped with the rate as chance, by a keyed hash of (seed, document
id, place of the segment in the text, number of the candidate).  So a seed always gives the same
segmentation, and every occurrence of a word in every document is cut on its own.
No piece crosses the start of a run of spaces, or holds a character that the vocabulary lacks, so texts are cut there.

The agendas of all segments of a batch are worked off together, a candidate of each at a time, as arrays.
Occurrences of a segment share a row until their draws part them.
Nothing is kept from one batch to the next.

Spaces are written as U+2581 with one put in front; characters that the vocabulary lacks, and a
literal U+2581, become byte pieces.  So every text decodes to itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, slices

RATE = 0.1
SEED = 11
#: Longer segments are worked off one by one, with a heap.
LONG = 64
#: Occurrences that are worked off together, and the widths up to which segments share a table.
_ROWS = 1 << 16
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, LONG)
_MARK = "▁"
_MASK = 2**64 - 1
#: A merge is written as its place in the agenda's order, times 2**20, and the symbol made; this stands for no merge.
_NONE = np.int64(2**62)
_MADE = (1 << 20) - 1
_STEP, _PLACE = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], dict[int, int]]:
    """Pieces with scores by id, and the ids of the byte pieces; read on the driver, a few hundred kilobytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    raw = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
    usable = [("" if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i), model.get_score(i)) for i in ids]
    return usable, raw


def _nth(k: int) -> np.uint64:
    """What the draw of the k-th candidate adds to its segment's key."""
    return U(k * int(_STEP) & _MASK)


class _Pairs:
    """Merges of symbol pairs, in an open-addressed table."""

    def __init__(self, found: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(found)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        for (a, b), rank in found.items():
            key = a << 32 | b
            at = (key * int(_STEP) & _MASK) >> (64 - bits)
            while self.key[at] >= 0:
                at = (at + 1) & self.mask
            self.key[at], self.rank[at] = key, rank

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = ((key.view(U) * _STEP) >> self.shift).astype(np.int64)
        met = self.key[at]
        out = np.where(met == key, self.rank[at], _NONE)
        open_ = np.flatnonzero((met != key) & (met >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            met = self.key[at[open_]]
            same = met == key[open_]
            out[open_[same]] = self.rank[at[open_[same]]]
            open_ = open_[~same & (met >= 0)]
        return out


class Coder:
    """Encodes and decodes with one vocabulary; a Python worker builds one beside the broadcast vocabulary.

    Symbols are numbered: pieces by id, then characters that occur in pieces only, then any other character by code point.
    """

    def __init__(self, pieces: list[tuple[str, float]], raw: dict[int, int], rate: float, seed: int):
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.rank = {p: -score for p, score in pieces if len(p) > 1}
        self.raw = raw
        self.seed = seed
        self.bytes = [p.replace(_MARK, " ").encode() for p, _ in pieces]
        for value, i in raw.items():
            self.bytes[i] = bytes([value])
        apart = " \n\t\r" + _MARK
        self.cut = re.compile(rf" *[^{apart}]+| +|[{apart[1:]}]")
        self.limit = min(int(rate * 2**64), _MASK)
        self.size = len(pieces)
        symbols = dict(self.ids)
        for c in sorted({c for p in self.rank for c in p} - symbols.keys()):
            symbols[c] = len(pieces) + len(symbols) - len(self.ids)
        self.base = len(pieces) + len(symbols) - len(self.ids)
        levels = {x: k for k, x in enumerate(sorted(set(self.rank.values())))}
        found = {}
        for p, x in self.rank.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    found[a, b] = levels[x] << 20 | symbols[p]
        self.pairs = _Pairs(found)
        self.symbol = np.arange(self.base, self.base + 0x110000, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.symbol[ord(" ")] = symbols.get(_MARK, self.base + ord(_MARK))
        self.symbol[ord(_MARK)] = self.base + ord(_MARK)
        self.only = {i: c for c, i in symbols.items() if i >= self.size}

    def segment(self, text: str, skipped: Callable[[int], bool] = lambda k: False) -> np.ndarray:
        """The symbols of one segment, by an agenda in a heap; candidate ``k`` that comes up is skipped where ``skipped(k)``."""
        rank, n = self.rank, len(text)
        literal, text = text == _MARK, text.replace(" ", _MARK)
        symbols: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k, k + 1, p) for k in range(n - 1) if (p := text[k : k + 2]) in rank]
        heapify(heap)
        come = 0
        while heap:
            _, k, j, p = heappop(heap)
            if symbols[k] is None or j >= n or symbols[j] is None or after[k] != j or symbols[k] + symbols[j] != p:
                continue
            come += 1
            if skipped(come - 1):
                continue
            symbols[k], symbols[j] = p, None
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                if (q := p + symbols[nxt]) in rank:
                    heappush(heap, (rank[q], k, nxt, q))
            prior = before[k]
            if prior >= 0 and (q := symbols[prior] + p) in rank:
                heappush(heap, (rank[q], prior, k, q))
        code = lambda s: self.base + ord(_MARK) if literal else self.ids[s] if s in self.ids else int(self.symbol[ord(s)])
        return np.array([code(s) for s in symbols if s is not None], np.int32)

    def _skips(self, base: int) -> Callable[[int], bool]:
        """Whether the candidates of the segment with this key are skipped, drawn as they come up."""
        drawn: list[bool] = []

        def skipped(k: int) -> bool:
            while k >= len(drawn):
                more = np.arange(len(drawn) + 1, len(drawn) + 129, dtype=U)
                drawn.extend((mix(U(base) + more * _STEP) < U(self.limit)).tolist())
            return drawn[k]

        return skipped

    def _agenda(self, flat: np.ndarray, ranks: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Works off the agendas of occurrences ``of`` segments ``flat[start : start + size]`` (``ranks`` of neighbours beside them).

        Occurrences of a segment share a row until their draws part them, so a row stands for a segment and the skips so far.
        Returns the row in which each occurrence ends, how many symbols rows have left, and the symbols of all rows in order.
        """
        into, lefts, symbols, ended = np.zeros(len(of), np.int64), [], [], 0
        counts = np.bincount(of, minlength=len(start))
        by_segment, first = np.argsort(of, kind="stable"), np.cumsum(counts) - counts
        by_size = np.argsort(size, kind="stable")
        widths, load = size[by_size], np.cumsum(counts[by_size])
        a = 0
        while a < len(by_size):
            width = min(w for w in _WIDTHS if w >= widths[a])
            upto = np.searchsorted(load, load[a] + _ROWS, "right")
            b = max(a + 1, min(np.searchsorted(widths, width, "right"), upto))
            rows, width = by_size[a:b], int(widths[b - 1])
            a = b
            at = start[rows][:, None] + np.arange(width)
            inside = np.arange(width) < size[rows][:, None]
            np.minimum(at, len(flat) - 1, out=at)
            s = np.where(inside, flat[at], -1)
            p = np.where(inside[:, 1:], ranks[at[:, : width - 1]], _NONE) if width > 1 else np.full((len(rows), 1), _NONE)
            n = counts[rows]
            row = np.repeat(np.arange(len(rows)), n)
            who = by_segment[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(len(row))]
            key = None if base is None else base[who]
            step = 0
            while len(s):
                k = (p >> 20).argmin(axis=1)  # the leftmost of equal scores
                best = p[np.arange(len(s)), k]
                live = best != _NONE
                if not live.all():
                    done = s[~live]
                    real = done >= 0
                    lefts.append(real.sum(axis=1))
                    symbols.append(done[real])
                    on = live[row]
                    into[who[~on]] = ended + (np.cumsum(~live) - 1)[row[~on]]
                    ended += len(done)
                    row, who, key = (np.cumsum(live) - 1)[row[on]], who[on], None if key is None else key[on]
                    s, p, k, best = s[live], p[live], k[live], best[live]
                    if not len(s):
                        break
                step += 1
                new_s, new_p, each = s[:0], p[:0], np.arange(len(s))
                if key is not None:
                    skip = mix(key + _nth(step)) < U(self.limit)
                    skipping = np.bincount(row[skip], minlength=len(s)) > 0
                    merging = np.bincount(row[~skip], minlength=len(s)) > 0
                    all_skip = np.flatnonzero(~merging)
                    p[all_skip, k[all_skip]] = _NONE
                    parted = np.flatnonzero(skipping & merging)
                    new_s, new_p = s[parted], p[parted]
                    new_p[np.arange(len(parted)), k[parted]] = _NONE
                    own = np.arange(len(s))
                    own[parted] = len(s) + np.arange(len(parted))
                    row = np.where(skip, own[row], row)
                    each = np.flatnonzero(merging)
                    k, best = k[each], best[each]
                if len(each):
                    s[each], p[each] = self._merged(s[each], p[each], k, best)
                s, p = np.concatenate([s, new_s]), np.concatenate([p, new_p])
        if not lefts:
            return into, np.zeros(0, np.int64), np.zeros(0, np.int32)
        return into, np.concatenate(lefts), np.concatenate(symbols)

    def _merged(self, s: np.ndarray, p: np.ndarray, k: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose pair at ``k`` became one symbol; what is to its right moves one place to the left."""
        new = np.full_like(s, -1)
        column = np.arange(s.shape[1] - 1)
        new[:, :-1] = np.where(column <= k[:, None], s[:, :-1], s[:, 1:])
        own = np.arange(len(s))
        new[own, k] = best & _MADE
        new_p = np.full_like(p, _NONE)
        new_p[:, :-1] = np.where(column[:-1] < k[:, None], p[:, :-1], p[:, 1:])
        new_p[own, k] = _NONE
        has = np.flatnonzero(new[own, k + 1] >= 0)
        new_p[has, k[has]] = self.pairs(new[has, k[has]], new[has, k[has] + 1])
        has = np.flatnonzero(k > 0)
        new_p[has, k[has] - 1] = self.pairs(new[has, k[has] - 1], new[has, k[has]])
        return new, new_p

    def _ids(self, symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of symbols, and their count for each segment of ``left`` symbols: those without a piece become bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, left
        size = np.ones(len(symbols), np.int64)
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        spelt = [(self.only[i] if i in self.only else chr(i - self.base)).encode() for i in kinds.tolist()]
        size[odd] = np.array([len(b) for b in spelt])[which]
        place = np.cumsum(size) - size
        out = np.repeat(symbols, size)
        for k, b in enumerate(spelt):
            at = place[odd[which == k]]
            for j, value in enumerate(b):
                out[at + j] = self.raw[value]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(left)])]
        return out, np.diff(ends)

    def encode_all(self, texts: list[str | None], docs: list[object]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and their offsets; with dropout every segment of every ``doc`` draws its own skips."""
        found = [self.cut.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(x) for x in found], np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        total = int(offsets[-1])
        if not total:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        known: defaultdict[str, int] = defaultdict(count().__next__)
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, total)
        unique = list(known)
        del found, known
        key = np.zeros(total, U)
        if self.limit:
            own = np.array([xxhash.xxh3_64_intdigest(str(d), self.seed & _MASK) for d in docs], U)
            place = np.arange(total) - np.repeat(offsets[:-1], counts)
            key = mix(np.repeat(own, counts) + place.astype(U) * _PLACE)

        size = np.array([len(p) for p in unique], np.int64)
        flat = self.symbol[np.frombuffer("".join(unique).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.cumsum(size) - size
        ranks = np.full(len(flat), _NONE)
        if len(flat) > 1:
            ranks[:-1] = self.pairs(flat[:-1], flat[1:])
        long = size > LONG
        short = np.flatnonzero(~long)
        nth = np.full(len(unique), -1)
        nth[short] = np.arange(len(short))
        own = nth[code]
        plain = own >= 0
        into, left, symbols = self._agenda(flat, ranks, start[short], size[short], own[plain], key[plain] if self.limit else None)
        ids, n = self._ids(symbols, left)
        pool, begin, length = [ids], np.zeros(total, np.int64), np.zeros(total, np.int64)
        begin[plain], length[plain] = (np.cumsum(n) - n)[into], n[into]
        filled = len(ids)
        for at in np.flatnonzero(~plain).tolist():
            part = unique[code[at]]
            symbols = self.segment(part, self._skips(int(key[at]))) if self.limit else self.segment(part)
            ids, n = self._ids(symbols, np.array([len(symbols)]))
            pool.append(ids)
            begin[at], length[at] = filled, len(ids)
            filled += len(ids)
        ids = np.concatenate(pool)
        ends = np.cumsum(length)
        out = ids[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]))]
        return out, np.concatenate([[0], ends])[offsets]

    def encode(self, text: str, doc: object = 0) -> np.ndarray:
        return self.encode_all([text], [doc])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode()


def _shipped(df: DataFrame, model_path: str | None, rate: float, seed: int) -> Broadcast:
    pieces, raw = vocabulary(model_path or default_model())
    return df.sparkSession.sparkContext.broadcast({"pieces": pieces, "raw": raw, "rate": rate, "seed": seed})


def _coder(shipped: Broadcast) -> Coder:
    state = shipped.value
    if "coder" not in state:
        state["coder"] = Coder(state["pieces"], state["raw"], state["rate"], state["seed"])
    return state["coder"]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>): null for a null text, empty for an empty one.

    All other columns pass unchanged; a column already named ``ids`` is replaced.  Rows of one id and
    text are segmented alike.
    """
    shipped = _shipped(docs, model_path, rate, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped)
        for part in slices(batches, text_col):
            text = part.column(text_col)
            ids, offsets = coder.encode_all(text.to_pylist(), part.column(id_col).to_pylist())
            found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=text.is_null())
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "ids"])

    plain = docs.drop("ids") if "ids" in docs.columns else docs
    return plain.mapInArrow(run, _with(plain, "ids array<int>"))


def decode(encoded: DataFrame, *, ids_col: str = "ids", into: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``into``: the text of each list of ids, null for null."""
    shipped = _shipped(encoded, model_path, 0.0, 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    plain = encoded.drop(into) if into in encoded.columns else encoded
    return plain.mapInArrow(run, _with(plain, f"`{into}` string"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``(id_col, n_ids, ids_sha256, decoded_sha256, lossless)``: every text encoded and decoded within one task.

    ``ids_sha256`` is over the ids as little-endian 32-bit values, ``decoded_sha256`` over the decoded
    text in UTF-8.  A null text has null digests, ``n_ids`` 0 and is lossless.
    """
    shipped = _shipped(docs, model_path, rate, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped)
        for part in slices(batches, "text"):
            rows = []
            texts = part.column("text").to_pylist()
            every, offsets = coder.encode_all(texts, part.column("id").to_pylist())
            for k, text in enumerate(texts):
                if text is None:
                    rows.append((0, None, None, True))
                    continue
                ids = every[offsets[k] : offsets[k + 1]]
                back = coder.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            n, a, b, same = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], names=["id", "n_ids", "ids_sha256", "decoded_sha256", "lossless"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_ids long, ids_sha256 string, decoded_sha256 string, lossless boolean").withColumnRenamed("id", id_col)
