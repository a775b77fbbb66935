"""Language identification by compression.

One zstandard raw-content dictionary a language; a text is encoded with each of them, block by
block to its end, and takes the language whose dictionary gives the fewest bytes.  The score is the
relative margin to the runner-up; narrow margins are rejected.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, unused

DICTIONARY_BYTES = 256 << 10
SAMPLE_DOCS = 2000
#: Of all dictionaries together: 64 of full size.
ALL_BYTES = 64 * DICTIONARY_BYTES
#: Places of a long text that are learnt from.
PIECES = 8
BLOCK_CHARS = 4096
#: Four-byte matches and a greedy search: short words count, and the search stays cheap.
SETTINGS = {"window_log": 20, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY, "chain_log": 16, "hash_log": 17, "search_log": 3, "write_content_size": False, "write_dict_id": False}
MIN_MARGIN = 0.004


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Runs of what is neither letter nor mark, and a letter, by Unicode category."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))

    def ranges(of: str) -> str:
        return "".join(rf"\U{m.start():08x}-\U{m.end() - 1:08x}" for m in re.finditer(f"[{of}]+", kinds))

    return re.compile(f"[^{ranges('LM')}]+"), re.compile(f"[{ranges('L')}]")


def letters(text: str) -> str:
    """Lower case, with one space for every run of anything but letters and their marks; empty without a letter."""
    other, letter = _patterns()
    return other.sub(" ", text).lower() if letter.search(text) else ""


def held_out(id_col: str) -> Column:
    """Rows set aside: crc32 of the id as text, modulo 4, is 2 (a null id is not set aside)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def spread(text: Column, share: Column) -> Column:
    """The text, or of a longer one ``PIECES`` pieces at even distances from its start to its end, ``share`` characters in all."""
    size, each = F.length(text), F.ceil(share / PIECES).cast("int")
    piece = lambda k: F.substring(text, (F.floor((size - each) * k / (PIECES - 1)) + 1).cast("int"), each)
    return F.when(size <= share, text).otherwise(F.concat_ws(" ", *[piece(F.lit(k)) for k in range(PIECES)]))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, all_bytes: int = ALL_BYTES) -> dict[str, bytes]:
    """A dictionary for each non-null language, the most frequent first.

    Learns from a bounded sample: of each language the ``sample_docs`` rows with the smallest hash of
    their id (all where it has fewer), and of each of those an equal share of the dictionary, in pieces from
    all over the text.  Beyond ``all_bytes / dictionary_bytes`` languages all dictionaries get smaller alike,
    so about ``all_bytes`` reach the driver however many there are.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return {}
    dictionary_bytes = min(dictionary_bytes, max(1, all_bytes // len(counts)))
    # The smallest hashes of a language lie below the bound but for chance; about twice the sample is exchanged, however large the table.
    plan = [(lang, min(2**63 - 1, -(2**63) + 2**64 * 2 * sample_docs // n), max(64, -(-2 * dictionary_bytes // min(sample_docs, n)))) for lang, n in counts.items()]
    known = F.broadcast(docs.sparkSession.createDataFrame(plan, "lang string, bound long, share int"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("t"))
    rows = rows.join(known, "lang").filter(F.col("h") <= F.col("bound")).select("lang", "h", spread(F.col("t"), F.col("share")).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    texts: dict[str, list[str]] = {}
    for r in rows.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).orderBy("lang", F.desc("rank")).toLocalIterator():
        texts.setdefault(r.lang, []).append(r.t)
    return {lang: " ".join(map(letters, x)).encode()[-dictionary_bytes:] for lang, x in ((a, texts[a]) for a in counts if a in texts)}


def predict(docs: DataFrame, model: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``id_col``, the ``keep`` columns, the text where asked for, ``lang_pred``, ``score`` (0 to 1) and ``accepted`` for every row.

    Null texts, texts without letters and every text under an empty model are ``und`` with score 0
    and not accepted; equal sizes go to the language first in the model (the most frequent); a margin under ``min_margin`` is
    not accepted.  With one language the margin is against no dictionary at all.
    """
    names, hidden = list(model), unused(docs, "text__")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings = zstandard.ZstdCompressionParameters(**SETTINGS)
        coders = []
        for name in names:
            made = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=settings)
            coders.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=made))
        if len(coders) == 1:
            coders.append(zstandard.ZstdCompressor(compression_params=settings))
        for part in slices(batches, hidden):
            langs, scores = [], []
            for text in part.column(hidden).to_pylist():
                text = letters(text or "")
                if not names or not text.strip():
                    langs.append("und")
                    scores.append(0.0)
                    continue
                blocks = [text[k : k + BLOCK_CHARS].encode() for k in range(0, len(text), BLOCK_CHARS)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
                best = min(range(len(names)), key=sizes.__getitem__)
                second = min(s for k, s in enumerate(sizes) if k != best)
                langs.append(names[best])
                scores.append(max(0.0, (second - sizes[best]) / second))
            names_out = [c for c in part.schema.names if with_text or c != hidden]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names_out), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names_out, "lang_pred", "score"])

    plain = docs.select(*dict.fromkeys([id_col, *keep]), F.col(text_col).cast("string").alias(hidden))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if with_text or f.name != hidden)
    out = plain.mapInArrow(run, f"{schema}, lang_pred string, score double")
    out = out.withColumnRenamed(hidden, text_col)
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("score") >= min_margin))
