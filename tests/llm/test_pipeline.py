"""The pipeline's stages, one after the other, against plain versions of what they decide."""

import random
from collections import Counter

from helpers import SCHEMA, near_components, words
from pyspark.sql import functions as F
from test_operators import plain_languages, plain_lines, plain_targets, texts_of

import corpus_pipeline
from querywright.llm import langid, lines, pieces


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["language_id"]
    said = plain_languages(langid.fit(before), texts_of(before))
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (lang, margin) in said.items() if lang != "und" and margin >= langid.MIN_MARGIN)
    assert after.count() >= 0.97 * before.count()
    before, after = kept["line_dedup"]
    assert texts_of(after) == plain_lines(texts_of(before))
    before, after = kept["minhash_near_dedup"]
    want, _ = near_components(texts_of(before), 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in want.items() if i == c)
    before, after = kept["mixing"]
    rows, sizes, taken = {r.doc_id: r for r in before.collect()}, Counter(), Counter()
    for r in rows.values():
        sizes[r.source] += len(words(r.text))
    mixed = after.collect()
    for r in mixed:
        taken[r.source] += len(words(r.text))
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in mixed) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    longest = max(len(words(r.text)) for r in rows.values())
    assert all(abs(taken[s] - goal) <= longest / 2 + 1 for s, goal in plain_targets(dict(sizes)).items())
    before, after = kept["sentencepiece"]
    assert pieces.decode(after).filter(F.col("decoded") != F.col("text")).count() == 0 and after.count() == before.count()


def test_stages_take_odd_and_empty_tables(spark, clashing, empty, sf_dir):
    for table in (clashing.select(empty.columns), empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).filter("ids IS NULL").count() == 0


def test_line_stage_keeps_unlike_lines_of_frequent_words_back(spark, monkeypatch):
    """Words with hundreds of unlike lines, as most are in a large corpus, have no word sets written for those lines."""
    draw = random.Random(9)
    texts = [" ".join(f"w{k}" for k in draw.sample(range(100), 20)) for _ in range(2500)]
    texts += [f"{t} more" for t in texts[:30]]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    written, saved = [], lines.saved

    def counting(df):
        out = saved(df)
        if "tokens" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(lines, "saved", counting)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeated_lines(spark, docs, "").collect()}
    assert got == {i: ("", 0) if i >= 2500 else (t, len(t)) for i, t in enumerate(texts)}
    assert written and sum(written) < 250  # every line's once
