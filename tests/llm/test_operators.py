"""Each corpus operator against a plain version on small tables, and on odd, clashing and empty ones."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import Groups, near_components, shingle_set, words
from pyspark.sql import functions as F

from querywright.llm import common, fingerprint, hnsw, langid, lines, minhash, mixing, pieces, pii, setjoin, substring, toxicity


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}


# --- shared pieces


def test_words_split_like_the_pattern():
    texts = ["a bb  ccc", "", None, " x\ty\x0bz\r\n", "é" * 70 + " q", "漢字 x", "end", "begin"]
    w = common.words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    assert [w.data[a : a + n].tobytes().decode() for a, n in zip(w.start, w.size, strict=True)] == [x for t in texts for x in words(t)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- 1 mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        out = {s: cap * sizes[s] if s in capped else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("table", ["small", "odd"])
def test_mixing_meets_targets(table, request):
    docs = request.getfixturevalue(table)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.plan(docs).collect()))


def test_mixing_is_systematic_beyond_the_largest(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.when(F.col("id") < 1500, "a").otherwise("b").alias("source"))
    got = mixing.plan(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 2 and all(abs(r.t - r.target) <= 40 for r in got)


def test_newton_solves_the_coupled_dual(spark):
    """Rates meet every source's target, are an exponential tilt by source and band, and no small change of the bands' multipliers lowers the dual."""
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 4000, (5, mixing.BANDS)).astype(float)
    tokens[4] = 0
    size = tokens.sum(axis=1)
    target = size * np.array([0.2, 1.7, 3.0, 0.9, 1.0])
    rows = [(f"s{k}", float(size[k]), tokens[k].tolist(), float(target[k])) for k in range(5)]
    got = {r.source: np.array(r.rates) for r in mixing.balance(spark.createDataFrame(rows, "source string, source_size double, tokens array<double>, target double")).collect()}
    rates = np.array([got[f"s{k}"] for k in range(5)])
    assert (tokens * rates).sum(axis=1) == pytest.approx(target, rel=1e-9) and (rates[2] == 3).all() and (rates[4] == 0).all()
    free = rates[[0, 1, 3]]
    assert free.max() < 3
    tilt = np.log(free)
    mu = tilt[0] - tilt[0].mean()
    assert np.abs((tilt - tilt.mean(axis=1, keepdims=True)) - mu).max() < 1e-6  # the bands' multipliers are the same in all sources
    goal = tokens.sum(axis=0) * target.sum() / size.sum()

    def dual(mu):
        value = mixing.RIDGE * target.sum() / 2 * (mu**2).sum() - goal @ mu + 3 * tokens[2] @ mu
        for k in (0, 1, 3):
            lam = np.log(target[k] / (tokens[k] @ np.exp(mu)))
            value += tokens[k] @ np.exp(lam + mu) - target[k] * lam
        return value

    best = min(np.linspace(-2, 2, 401), key=lambda c: dual(mu + c))
    centre = mu + best
    assert all(dual(centre) <= dual(centre + d) + 1e-3 for d in 0.05 * np.eye(mixing.BANDS)) and all(dual(centre) <= dual(centre - d) + 1e-3 for d in 0.05 * np.eye(mixing.BANDS))


def test_mixing_odd_tables(clashing, empty):
    assert mixing.plan(clashing).count() == clashing.count()
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == mixing.plan(clashing).agg(F.sum("copies")).first()[0]
    assert mixing.plan(empty).count() == mixing.mixed(empty).count() == 0


# --- 2 substrings


def plain_cut(texts, n=13):
    first, split = {}, {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][k : k + n]), i)
    out = {}
    for i, w in split.items():
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                keep[k : k + n] = [False] * n
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("table", ["small", "odd"])
def test_substrings(table, request):
    docs = request.getfixturevalue(table)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(docs).collect()}
    assert got == plain_cut(texts_of(docs))


def test_substrings_odd_tables(clashing, empty):
    got = substring.deduplicate(clashing).collect()
    assert len(got) == clashing.count()
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 0]
    assert sum(r.n_removed for r in got if r.doc_id == 3) == 2 * plain_cut(texts_of(clashing))[3][1]
    assert substring.deduplicate(empty).count() == 0


def test_substring_with_colliding_short_names(spark):
    """Two texts whose 31-bit names are the same still share their passage."""
    shared = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"{shared} tail58736"), (2, f"{shared} tail59526")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.deduplicate(docs).collect()} == {1: 0, 2: 20}



def test_recompression_is_local():
    """What stands around a passage does not change the anchors of its windows."""
    passage = " ".join(f"p{k}" for k in range(40)) + " q q q r"
    columns = pa.array([passage, "a b c " + passage + " d", "z " * 9 + passage])
    w = common.words(columns)
    at, doc, anchor = substring.anchors(w, 13)
    own = [anchor[doc == d] for d in range(3)]
    n = len(own[0])
    assert (own[1][3 : 3 + n] == own[0]).all() and (own[2][9 : 9 + n] == own[0]).all()


# --- 3 MinHash


@pytest.mark.parametrize(("table", "n"), [("small", 2), ("odd", 2), ("odd", 5)])
def test_minhash(table, n, request):
    docs = request.getfixturevalue(table)
    want, sets = near_components(texts_of(docs), n)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(docs, n=n).collect()}
    assert got == {i: (want[i], len(sets[i]), want[i] == i) for i in want}


def test_minhash_odd_tables(clashing, empty):
    got = minhash.near_duplicates(clashing, n=2).collect()
    assert len(got) == clashing.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3, 7)} == {1}  # two texts of id 1 join their groups
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[50:])) for i in range(120)] + [(500 + i, " ".join(f"u{i}_{k}" for k in range(20)) + " " + " ".join(base[:12])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()}
    assert all(got[i] == 0 for i in range(120)) and all(got[500 + i] == 500 + i for i in range(60))


def test_min_max_estimates_likeness():
    rng = np.random.default_rng(3)
    a, b = minhash._permutations(512)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    y = np.concatenate([x[:600], rng.integers(0, 2**63, 300).astype(np.uint64)])
    assert (minhash.min_max(x, a, b) == minhash.min_max(y, a, b)).mean() == pytest.approx(600 / 1200, abs=0.05)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_set_join_finds_every_pair(spark, percent):
    rng = np.random.default_rng(percent)
    sets = [set(rng.choice(30, rng.integers(1, 15), replace=False).tolist()) for _ in range(60)]
    sets += [set(list(s)[1:]) | {99} for s in sets[:30]]
    rows = [(i, i, len(s), h) for i, s in enumerate(sets) for h in s]
    found = {(r.a, r.b) for r in setjoin.candidate_pairs(spark.createDataFrame(rows, "id long, c long, n long, h long"), percent).collect()}
    true = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert true <= found


# --- 4 vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_hnsw_links_and_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24))
    centre = rng.normal(size=24)
    x[100:260] = centre + 0.05 * rng.normal(size=(160, 24))
    x[300:340] = x[340:380] + 0.2 * rng.normal(size=(40, 24))
    x[500:505] = x[505]
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] + [1.0] * 23, 1), (2004, [None] + [1.0] * 23, 1), (2005, [], 1), (2006, [1.0, 2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(vectors(spark, rows)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    groups = Groups()
    for a, b in zip(*np.nonzero(linked), strict=True):
        groups.link(int(a), int(b))
    true = linked.sum(axis=1)
    assert sum(got[i][0] for i in range(900)) >= 0.99 * true.sum()
    assert all(got[i][0] <= true[i] for i in range(900))
    assert {i: got[i][1] for i in range(900)} == {i: groups.root(i) for i in range(900)}
    assert all(got[i] == (0, i, True) for i in range(2000, 2007))


@pytest.mark.parametrize("same", [True, False])
def test_hnsw_links_of_a_large_group(monkeypatch, same):
    """A group far larger than any beam, on both sides: counts agree with brute force and with each other."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[:900] = rng.normal(size=16) + 0.1 * rng.normal(size=(900, 16))
    x[900:960] = x[960:1020] + 0.1 * rng.normal(size=(60, 16))
    y = x if same else np.concatenate([x[100:300] + 0.1 * rng.normal(size=(200, 16)), x[920:980], rng.normal(size=(300, 16))])
    monkeypatch.setattr(hnsw, "HEAVY", 64)
    graphs = [hnsw.Graph.build(hnsw._unit(v), np.arange(len(v)) + k) for k, v in enumerate([x] if same else [x, y])]
    back = [hnsw.Graph.unpacked(g.x, *[np.asarray(z) for z in (g.packed()[0], g.packed()[1].flatten())]) for g in graphs]
    for g, h in zip(graphs, back, strict=True):
        assert all((p == q).all() for k, m in zip(g.layers, h.layers, strict=True) for p, q in zip(k, m, strict=True))
    chosen, true = hnsw.sampled_links(back[-1].x, back[0].x, 0.9, same)
    assert true.sum() >= hnsw.AUDIT_LINKS and not (same and true[np.arange(len(chosen)), chosen].any())
    copies = rng.integers(1, 3, len(x) + (0 if same else len(y)))
    links = hnsw._Links(x, y, same, copies, 0.9)
    a, b, hx = hnsw.audited(back[-1], back[0].x, 0.8999, own=same)
    d, c, hy = (b, a, hx) if same else hnsw.audited(back[0], back[-1].x, 0.8999)
    assert len(hx) > 500
    pairs = {(min(i, j), max(i, j)) if same else (i, j) for i, j in [*zip(a.tolist(), b.tolist()), *zip(c.tolist(), d.tolist())]}  # noqa: B905
    pairs = np.array(sorted(p for p in pairs if p[0] not in set(hx) and p[1] not in set(hy) and not (same and p[0] == p[1])))
    links.light(pairs[:, 0], pairs[:, 1])
    skip = np.zeros(len(x), bool)
    skip[hx] = True
    links.heavy(hx, True, np.zeros(len(y), bool))
    if not same:
        links.heavy(hy, False, skip)
    u, v = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    linked = u @ v.T >= 0.9
    groups = Groups()
    if same:
        np.fill_diagonal(linked, False)
        want = linked @ copies
    else:
        want = np.concatenate([linked @ copies[len(x) :], linked.T @ copies[: len(x)]])
    assert links.count.sum() >= 0.99 * want.sum() and (links.count <= want).all() and (links.count[hx] == want[hx]).all()
    for i, j in zip(*np.nonzero(linked), strict=True):
        groups.link(int(i), int(j) + (0 if same else len(x)))
    assert [groups.root(i) for i in range(len(copies))] == [groups.root(i) for i in links.label.tolist()]
    assert len(set(links.label.tolist())) == len({groups.root(i) for i in range(len(copies))})


def test_hnsw_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.01, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False), (None, 0, None, True)], key=str)
    assert hnsw.near_duplicates(vectors(spark, [])).count() == 0


# --- 5 fingerprints


def test_fingerprints_with_edits(odd, small):
    for docs in (odd, small):
        texts = {i: t or "" for i, t in texts_of(docs).items()}
        got = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
        order = sorted(texts, reverse=True)
        for a, b in zip(order, order[1:] + order[:1], strict=True):
            half = len(texts[a]) // 2
            edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
            assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[a].n_chars == len(texts[a])
            for near, other in ((got[a].near_edited, edited), (got[a].near_next, texts[b])):
                x, y = shingle_set(texts[a], 5), shingle_set(other, 5)
                assert abs(near - (len(x & y) / len(x | y) if x | y else 1.0)) <= 0.2


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{k}" for k in range(2000)), " ".join(f"w{k}" for k in range(1000, 3000))
    x, y = fingerprint.sketches(pa.array([a, b]))
    assert fingerprint.resemblance(x, y) == pytest.approx(996 / 2996, abs=0.12)
    assert fingerprint.distinct(x) == pytest.approx(1996, rel=0.3)
    assert fingerprint.containment(x, y) == pytest.approx(0.5, abs=0.2)
    assert (fingerprint.decode(fingerprint.encode(x)) == x).all()
    prints = fingerprint.fingerprints(spark.createDataFrame([(1, a), (2, b), (3, None)], "doc_id long, text string"))
    assert prints.filter("doc_id = 3").first().fingerprint == ""
    whole = fingerprint.merged(prints.withColumn("g", F.lit(1)), ["g"]).first().fingerprint
    assert whole.replace("\r\n", "") == fingerprint.encode(fingerprint.merge(x, y))


def test_fingerprints_odd_tables(clashing, empty):
    assert fingerprint.with_edits(clashing).count() == clashing.count()
    assert fingerprint.with_edits(empty).count() == 0


# --- 6 language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    got = langid.predict(docs, model, keep=("lang",)).withColumn("held", langid.held_out("doc_id")).filter("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_tables(clashing, empty):
    model = langid.fit(clashing)
    got = langid.predict(clashing, model).collect()
    assert len(got) == clashing.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"} and not any(r.accepted for r in got if r.doc_id in (4, 5, 6))
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(clashing, {}).collect()} == {"und"}


def test_language_dictionaries_of_many_and_rare_languages(spark):
    def word(lang, k):
        return "".join(chr(97 + (lang * 7 + k * 5 + j * (lang + 3)) % 26) for j in range(4 + (lang + k) % 4)) + chr(97 + lang % 26) + chr(97 + lang // 26)

    rows = [(100 * a + d, " ".join(word(a, (d * 3 + j) % 40) for j in range(60)), f"l{a:02d}") for a in range(70) for d in range(4 if a == 69 else 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model) == 70  # the rarest was left out beyond 64
    fresh = spark.createDataFrame([(1, " ".join(word(69, j) for j in range(30)))], "doc_id long, text string")
    assert langid.predict(fresh, model).first().lang_pred == "l69"
    header = "shared header " * 100
    long = [(d, header + " ".join(f"{'abcdefghij'[d]}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(3000)) + " finish", "xx") for d in range(10)]
    held = langid.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"))["xx"]
    assert len(held) > 50_000 and b"finish" in held and held.count(b"header") < len(held) / 100


def test_language_letters_keep_marks_and_drop_numbers(spark):
    assert langid.letters("हिन्दी é 12 ½²") == "हिन्दी é " and langid.letters("½ ² _") == "" == langid.letters("\u0301")
    docs = spark.createDataFrame([(1, "½ ²"), (2, "12 _"), (3, "plain words here")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, {"en": b"plain words here and there", "xx": b"qq ww"}).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}


def plain_languages(model, texts):
    """The language whose dictionary gives the smallest sum of compressed blocks, and the margin, by plain zstandard calls."""
    import zstandard

    settings = zstandard.ZstdCompressionParameters(**langid.SETTINGS)
    coders = {n: zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, d in model.items()}
    out = {}
    for i, t in texts.items():
        t = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (t or ""))).lower()
        if not t.strip():
            out[i] = ("und", 0.0)
            continue
        sizes = {n: sum(len(c.compress(t[k : k + langid.BLOCK_CHARS].encode())) for k in range(0, len(t), langid.BLOCK_CHARS)) for n, c in coders.items()}
        best = min(sizes, key=lambda n: (sizes[n], list(model).index(n)))  # noqa: B023
        second = min(x for n, x in sizes.items() if n != best)
        out[i] = (best, round(max(0.0, (second - sizes[best]) / second), 9))
    return out


def test_language_equals_plain_compression(small):
    model = langid.fit(small.filter(~langid.held_out("doc_id")))
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(small, model).collect()}
    assert got == plain_languages(model, texts_of(small))


# --- 7 pieces


def test_pieces_equal_the_library_without_dropout(odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    vocabulary, raw = pieces.vocabulary(pieces.default_model())
    coder = pieces.Coder(vocabulary, raw, 0.0, 0)
    for text in [t for t in texts_of(odd).values() if t and "▁" not in t] + ["  two  spaces\n\nlines ", "a" * 500]:
        assert coder.encode(text).tolist() == model.encode(text)


def test_pieces_round_trip(clashing, empty):
    coded = pieces.encode(clashing)
    back = pieces.decode(coded).collect()
    assert len(back) == clashing.count() and all(r.decoded == r.text for r in back)
    assert all((r.ids is None) == (r.text is None) for r in back)
    assert all(r.lossless for r in pieces.digests(clashing).collect())
    assert pieces.encode(empty).count() == pieces.digests(empty).count() == 0


def test_dropout_is_seeded_and_varied():
    vocabulary, raw = pieces.vocabulary(pieces.default_model())
    text = "segmentations of words and sentences vary with the seed " * 20
    one, again, other = (pieces.Coder(vocabulary, raw, 0.2, s) for s in (1, 1, 2))
    assert one.encode(text, 0).tolist() == again.encode(text, 0).tolist()
    assert one.encode(text, 0).tolist() != other.encode(text, 0).tolist()
    assert one.encode(text, 0).tolist() != one.encode(text, 1).tolist()
    assert one.decode(one.encode(text, 1)) == text
    assert len(one.encode(text)) > len(pieces.Coder(vocabulary, raw, 0.0, 1).encode(text))


def plain_pieces(coder, text, doc):
    """Merge by merge over lists of strings, with the same keyed draws."""
    out, key = [], xxhash.xxh3_64_intdigest(str(doc), coder.seed)
    for place, part in enumerate(coder.cut.findall(" " + text) if text else []):
        base = common.mix(np.array([(key + place * int(pieces._PLACE)) % 2**64], np.uint64))[0]
        literal, symbols = part == "▁", list(part.replace(" ", "▁"))
        never = float("inf")
        score = lambda a, b: coder.rank.get(a + b, never)
        agenda = [score(a, b) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        come = 0
        while agenda and min(agenda) != never:
            k = agenda.index(min(agenda))
            come += 1
            if coder.limit and int(common.mix(np.array([(int(base) + come * int(pieces._STEP)) % 2**64], np.uint64))[0]) < coder.limit:
                agenda[k] = never
                continue
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = score(symbols[k], symbols[k + 1])
            if k:
                agenda[k - 1] = score(symbols[k - 1], symbols[k])
        for x in symbols:
            out += [coder.raw[b] for b in x.encode()] if literal or x not in coder.ids else [coder.ids[x]]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_pieces_equal_a_plain_agenda(odd, rate):
    vocabulary, raw = pieces.vocabulary(pieces.default_model())
    coder = pieces.Coder(vocabulary, raw, rate, 11)
    texts = [t if t is None else t[:4000] for t in texts_of(odd).values()] + ["segmentation " * 50, "x" * 90 + " " + "segmentation" * 8, "  two  spaces\n\n", "a▁b"]
    ids, offsets = coder.encode_all(texts, list(range(len(texts))))
    for k, text in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]].tolist()
        assert own == plain_pieces(coder, text or "", k) == coder.encode(text or "", k).tolist()
        assert coder.decode(np.array(own)) == (text or "")


def test_dropout_cuts_every_occurrence_on_its_own():
    vocabulary, raw = pieces.vocabulary(pieces.default_model())
    coder = pieces.Coder(vocabulary, raw, 0.1, 11)
    cuts = [[coder.encode("segmentation " * 50, doc).tobytes()] for doc in range(40)]
    assert len({c[0] for c in cuts}) == 40
    one = coder.encode("segmentation " * 200, 7)
    assert len({x.tobytes() for x in np.split(one, np.flatnonzero([coder.bytes[i].startswith(b" ") for i in one]))}) > 4  # within one document
    assert pieces.Coder(vocabulary, raw, 1.0, 1).encode("word").tolist() == [coder.ids[c] for c in "▁word"]


# --- 8 toxicity


def test_toxicity_finds_words_of_abuse(spark):
    calm = [(i, f"the meeting {i} was about item {i % 13} and plan {i % 7}", 0) for i in range(300)]
    rude = [(1000 + i, f"the meeting {i} was about an {('idiot', 'moron')[i % 2]} and plan {i % 7}", 1 + i % 2) for i in range(120)]
    rows = spark.createDataFrame(calm + rude, "doc_id long, text string, grade int")
    held = F.col("doc_id") % 5 == 0
    model = toxicity.fit(rows.filter(~held), rows.filter(~held).select("doc_id", "grade"))
    got = toxicity.score(rows.filter(held), model).join(rows.withColumnRenamed("grade", "true"), "doc_id").collect()
    assert sum(r.toxic == (r.true > 0) for r in got) >= 0.97 * len(got)
    worse = [np.mean([r.severity for r in got if r.true == g]) for g in (0, 1, 2)]
    assert worse[0] < worse[1] < worse[2]
    assert list(model.threshold) == sorted(model.threshold)


def test_ordinal_fit_is_a_penalised_optimum():
    """Against a plain likelihood: no weight or threshold can be moved to lower it by more than the penalty costs."""
    rng = np.random.default_rng(2)
    x = rng.random((600, 10)) < 0.3
    latent = x @ np.array([2.0, -1.5, 1.0, 0.5, 0, 0, 0, 0, 0, 0]) + rng.logistic(size=600)
    grade = (latent > 0.8).astype(int) + (latent > 2.2)
    doc, feature = np.nonzero(x)
    l1 = 0.004
    model = toxicity.train(doc, feature + 100, grade, steps=6000, l1=l1)
    w = np.zeros(10)
    w[model.feature - 100] = model.weight

    def loss(w, t):
        edge = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], t, [np.inf]])[None, :] - (x @ w)[:, None])))
        return -np.log(edge[np.arange(600), grade + 1] - edge[np.arange(600), grade]).mean()

    step = 1e-4
    slope = [(loss(w + step * e, model.threshold) - loss(w - step * e, model.threshold)) / (2 * step) for e in np.eye(10)]
    for g, v in zip(slope, w, strict=True):
        assert abs(g + l1 * np.sign(v)) < 1e-3 if v else abs(g) < l1 + 1e-3
    tilt = [(loss(w, model.threshold + step * e) - loss(w, model.threshold - step * e)) / (2 * step) for e in np.eye(2)]
    assert np.abs(tilt).max() < 1e-3 and w[:3].all() and not w[5:].all()


def test_toxicity_of_one_grade(spark):
    rows = spark.createDataFrame([(i, f"plain words {i}", 0) for i in range(50)], "doc_id long, text string, grade int")
    model = toxicity.fit(rows, rows.select("doc_id", "grade"))
    assert len(model.feature) == 0 and all(r.severity < 0.05 for r in toxicity.score(rows, model).collect())


def test_toxicity_odd_tables(clashing, empty):
    labels = clashing.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    model = toxicity.fit(clashing, labels)
    got = toxicity.score(clashing, model).collect()
    assert len(got) == clashing.count() and all(r.severity == 0 for r in got if r.doc_id in (4, 5, 6))
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# --- 9 lines


def plain_lines(texts):
    held, sets, seen, out = defaultdict(list), [], {}, {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = None
            continue
        kept = []
        for line in texts[i].split("\n"):
            w = frozenset(words(line, lower=True))
            if not w:
                kept.append(line)
                continue
            if w in seen:
                continue
            common_ = Counter(j for a in w for j in held[a])
            hit = any(100 * c >= 80 * (len(w) + len(sets[j]) - c) for j, c in common_.items())
            seen[w] = len(sets)
            for a in w:
                held[a].append(len(sets))
            sets.append(w)
            if not hit:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("table", ["small", "odd"])
def test_lines(table, request):
    docs = request.getfixturevalue(table)
    got = lines.deduplicate(docs)
    assert {r.doc_id: r.text for r in got.collect()} == plain_lines(texts_of(docs))


def test_lines_with_many_partners(spark):
    """More alike and nearly alike lines than are looked at first."""
    base = [f"w{k}" for k in range(20)]
    rows = [(i, " ".join(base[:14] + [f"x{i}_{k}" for k in range(4)])) for i in range(40)]
    rows += [(100 + i, " ".join(base[:19] + [f"y{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.deduplicate(docs).collect()} == plain_lines(dict(rows))


def test_lines_of_crowded_words(spark):
    """First looks that are far too small leave the result as it is."""
    base = [f"w{k}" for k in range(20)]
    rows = [(i, " ".join(base[:15] + [f"x{i % 7}_{k}" for k in range(3)])) for i in range(30)]
    rows += [(100 + i, " ".join(base[:19] + [f"y{i}"]) + "\n" + " ".join(f"v{(i * 3 + k) % 50}" for k in range(90))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.id: r.cut for r in lines.near_duplicate_lines(docs, most=1, reach=2).collect()}
    want = {i: [k for k, line in enumerate(t.split("\n")) if line not in plain_lines(dict(rows))[i].split("\n")] for i, t in rows}
    assert cut == {i: c for i, c in want.items() if c}


def test_unlike_lines_of_one_word_stay_in_its_task():
    """A word that thousands of unlike lines share sends on its few likely pairs, not the rows of all lines."""
    draw = random.Random(3)
    texts = [" ".join(["shared"] + [f"w{draw.randrange(100_000)}" for _ in range(19)]) for _ in range(3000)]
    texts += [f"{t} more" for t in texts[:40]]
    rarity = np.full(1 << lines.CELL_BITS, 200, np.uint8)
    rarity[int(common.words(pa.array(["shared"])).hash[0] >> np.uint64(64 - lines.CELL_BITS))] = 10
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    posted = pa.Table.from_batches(lines._poster(SimpleNamespace(value=rarity), 80)([rows])).sort_by([(k, "ascending") for k in ("word", "k1", "id", "place")])
    met = pa.Table.from_batches(lines._meeter(80, lines.MOST, lines.REACH)(posted.combine_chunks().to_batches()))
    assert met.column("oid").null_count == 0 and len(met) < 1000  # all 3040 rows of the word were returned as crowded once
    assert {(3000 + k, k) for k in range(40)} <= set(zip(met.column("id").to_pylist(), met.column("oid").to_pylist(), strict=True))


def test_lines_of_words_with_many_rows(spark):
    """Short and long lines, unlike ones and groups of near copies, that share words with more rows than are compared one by one."""
    draw = random.Random(5)
    some = lambda n: [f"w{k}" for k in draw.sample(range(150), n)]
    texts = [some(draw.randrange(3, 110)) for _ in range(700)]
    texts += [["shared", *some(draw.randrange(3, 110))] for _ in range(200)]
    texts += [[w for w in base if draw.random() > 0.05] + [f"x{draw.randrange(5)}"] for base in (["shared", *some(30)], some(90)) for _ in range(120)]
    draw.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = plain_lines(dict(rows))
    for bounds in ({}, {"most": 3}, {"reach": 60}):
        cut = lines.near_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), **bounds)
        assert {r.id for r in cut.collect()} == {i for i, t in rows if t != want[i]}


def test_word_counts_in_steps(spark, small):
    docs = small.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).repartition(7)
    described = docs.mapInArrow(lines._describe, lines._DESCRIBED).cache()
    tables = [lines.rarity_table(described, at_once=k) for k in (256, 2)]
    counts = Counter()
    for r in docs.collect():
        counts.update((common.words(pa.array([r.text]), lower=True).hash >> np.uint64(64 - lines.CELL_BITS)).tolist())
    want = np.zeros(1 << lines.CELL_BITS, np.uint8)
    for cell, n in counts.items():
        want[cell] = min(255, int(8 * np.log2(n)))
    assert (tables[0] == want).all() and (tables[1] == want).all()
    described.unpersist()


@pytest.mark.parametrize("texts", [[None, None], ["", " \n ", "\t"], ["", "a b c"], [None, "a b c", "A  b c"]])
def test_lines_without_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    assert {r.doc_id: r.text for r in lines.deduplicate(docs).collect()} == plain_lines(dict(enumerate(texts)))


def test_lines_odd_tables(clashing, empty):
    got = lines.deduplicate(clashing).collect()
    assert len(got) == clashing.count()
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert lines.deduplicate(empty).count() == 0


# --- 10 PII


def test_pii_surrogates(spark):
    rows = [
        (1, "Mail Jean.DUPONT99@mail3.Example.com or jean.dupont99@mail3.example.com, call +1 (017) 555-7713"),
        (2, "ip 152.143.123.131### card 4111111111111111 and 4111-1111-1111-1111 key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
        (3, "Mr. John Smith met Mrs Anna Smith and Mr Smith; Dr. Иван Петров; SSN 123-45-6789"),
        (4, None), (5, ""), (6, "nothing in 2024-01-02 v1.2.3"),
    ]
    got = {r.doc_id: r for r in pii.anonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one, two, three = (got[i].text for i in (1, 2, 3))
    mails = re.findall(r"\S+@\S+\.com", one)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and re.match(r"[A-Z][a-z]{3}\.[A-Z]{6}\d\d@", mails[0])
    assert re.search(r"call \+\d \(\d{3}\) \d{3}-\d{4}$", one) and "555-7713" not in one
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", two)
    assert cards[0] == cards[1].replace("-", "") != "4111111111111111"
    digits = [int(c) for c in cards[0]]
    assert (sum(digits[1::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[0::2])) % 10 == 0  # the check digit still holds
    assert re.search(r"key [0-9a-f]{40}$", two) and "152.143" not in two and "###" in two
    names = re.findall(r"(?:Mr|Mrs)\.? (?:\w+ )?(\w+)", three)
    assert len(set(names)) == 1 and "Smith" not in three and re.search(r"Dr\. [А-Яа-я]+ [А-Яа-я]+", three)
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}", three)
    assert (got[4].text, got[5].text, got[6].text) == (None, "", rows[5][1])
    assert [got[i].n_entities for i in range(1, 7)] == [3, 4, 5, 0, 0, 0]


def test_pii_surrogates_are_distinct(spark):
    rows = [(i, f"a@b{i % 10}.io and 1{i:03d}.2 call 0{i % 100:02d}-55-{i:04d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    entities = docs.select(F.explode(pii.mentions(F.col("text"))).alias("m")).select(pii.kind_of(F.col("m")).alias("kind"), pii.canonical(F.col("m")).alias("canon")).distinct()
    before = entities.count()
    moved = pii.exceptions(entities)
    final = entities.join(moved, ["kind", "canon"], "left").select("kind", "canon", pii.surrogate_form(F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0)), pii.KEY).alias("form"))
    assert final.select("kind", "form").distinct().count() == before
    assert final.join(entities.select("kind", F.col("canon").alias("form")), ["kind", "form"], "left_semi").count() == 0


def test_pii_finds_whole_names_and_secrets_without_digits(spark):
    whole = ["Mr. McDonald", "Mr. O'Brien", "Dr. J. Smith", "Mr. SMITH", "Mr. Ronald McDonald", "Frau Smith-Jones", "Dr. Mary Ann Evans", "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghijklmnopqrst", "a1" * 100]
    docs = spark.createDataFrame(list(enumerate([f"then {m} left" for m in whole])), "doc_id long, text string")
    got = {r.doc_id: r.found for r in docs.select("doc_id", pii.mentions(F.col("text")).alias("found")).collect()}
    assert [got[k] for k in range(len(whole))] == [[m] for m in whole]
    last = {r.m: r.canon for r in spark.createDataFrame([(m,) for m in whole], "m string").select("m", pii.canonical(F.col("m")).alias("canon")).collect()}
    assert last["Dr. Mary Ann Evans"] == "evans" and last["Mr. Ronald McDonald"] == last["Mr. McDonald"] == "mcdonald"
    assert all(m not in r.text for m, r in zip(whole, pii.anonymize(docs).orderBy("doc_id").collect(), strict=True))


def test_pii_persons_are_distinct_and_stay_themselves(spark):
    """Thousands of persons: the same one reads the same under any title and without one, no two read alike, none keeps a name."""
    given, sur = [f"{a}{b}{c}" for a in ("Al", "Be", "Ca", "Do") for b in "bdfklmnrst" for c in ("a", "e", "io", "us")], [f"{a}{b}" for a in ("Mor", "Tan", "Vel", "Wim") for b in ("ley", "sen", "ter", "ford")]
    persons = [(g, s) for g in given for s in sur]
    titles = [("Mr", "Mrs")[k % 2] for k in range(len(persons))]
    rows = [(k, f"{titles[k]} {g} {s} wrote. Then {g} {s} left, and {s} was gone.") for k, (g, s) in enumerate(persons)]
    rows += [(10000 + k, f"Dr. {g} {s} came; {g.upper()} {s.upper()} did not. Prof {s}") for k, (g, s) in enumerate(persons)]
    got = {r.doc_id: r.text for r in pii.anonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    full = {}
    for k, (g, s) in enumerate(persons):
        title, one, two, again_one, again_two, alone = re.fullmatch(r"(\w+) (\w+) (\w+) wrote. Then (\w+) (\w+) left, and (\w+) was gone.", got[k]).groups()
        assert title == titles[k] and (one, two) == (again_one, again_two) and alone == two and one.endswith("n" if title == "Mr" else "a")
        assert one != g and two != s
        other = re.fullmatch(r"Dr. (\w+) (\w+) came; (\w+) (\w+) did not. Prof (\w+)", got[10000 + k]).groups()
        assert other == (one, two, one.upper(), two.upper(), two)
        full[g, s] = (one, two)
    assert len(set(full.values())) == len(persons)
    assert len({two for _, two in full.values()}) == len(sur)
    assert not {(a.lower(), b.lower()) for a, b in full.values()} & {(a.lower(), b.lower()) for a, b in persons}


def test_pii_initials_and_capitals(spark):
    rows = [(1, "Mr. J. SMITH and Mr. K. SMITH met Dr. J. Smith")]
    text = pii.anonymize(spark.createDataFrame(rows, "doc_id long, text string")).first().text
    one, two, three = re.fullmatch(r"Mr. (\w). ([A-Z]+) and Mr. (\w). \2 met Dr. (\w). (?:\w+)", text).group(1, 3, 4)
    assert one != two and one == three and "J" not in (one, three) and "K" != two


def test_pii_odd_tables(clashing, empty):
    got = pii.anonymize(clashing)
    assert got.count() == clashing.count() and set(clashing.columns) <= set(got.columns)
    assert pii.anonymize(empty).count() == 0
