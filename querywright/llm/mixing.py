"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r.  Of all rates that give every source its target, ``sum of r * size = target``, and keep
the corpus's mix of short and long documents (tokens by length band, within a ridge), those of least relative
entropy to the documents' own tokens are taken.  The dual is convex, with a multiplier a source and one a band, which are
coupled since sources differ in their lengths; its solution tilts documents exponentially,
``r = min(cap, exp(lambda[source] + mu[band]))``.

Newton iterations run on Spark: each solves every source's multiplier for the bands' current ones, beside its row, and sums gradient
and Hessian of the bands over all sources (their own part eliminated); a system of as many numbers as there are bands
is solved between iterations.  Documents of one source and band have one rate, so the sums need the table of token totals only.

Rates are then rounded into copies.  The largest documents of a source are rounded in order of size, each
making up for the error so far; the others are taken systematically, as the sum of rates along an order by size passes
whole numbers, with rates corrected for what the largest took.  Everything is DataFrame functions;
a large source is dealt to many tasks by size class and salt.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.extras import with_place
from .common import WORD, saved, unused

CAP = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
LARGEST = 64
#: Rows of a source, size class and salt that are ordered in one task.
CELL_ROWS = 1 << 14
BANDS = 8
#: How firmly bands are held, how near the dual's gradient comes to zero (as a share of all tokens), and Newton steps at most.
RIDGE, NEAR, NEWTON_STEPS = 0.05, 1e-7, 25
_INNER = 60


def size_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: Column) -> Column:
    """Two classes for every doubling of the size."""
    return F.floor(2 * F.log2(size + 1)).cast("int")


def band_of(size: Column) -> Column:
    """Four classes a length band, eight bands: up to 2 words, up to 14, 62 and so on, the last without end."""
    return F.least(F.floor(class_of(size) / 4).cast("int"), F.lit(BANDS - 1))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(source, source_size, docs, tokens, target)`` from rows of ``(source, size)``; ``tokens`` by band.

    Sources in code point order, null last, take ``weights`` in turn and share the total by them.  A
    target stops at ``cap`` times its source's size; the excess is shared anew by weight, round by round, until none is above.
    """
    cells = sizes.groupBy("source", band_of(F.col("size")).alias("band")).agg(F.sum("size").alias("tokens"), F.count("*").alias("docs"))
    held = F.map_from_entries(F.collect_list(F.struct("band", F.col("tokens").cast("double"))))  # one entry a band
    sources = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("docs").alias("docs"), held.alias("held"))
    by_band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.element_at("held", b), F.lit(0.0)))
    placed = with_place(sources.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    weighed = saved(placed.select("source", "source_size", "docs", by_band.alias("tokens"), weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("full")))

    total, open_weight, sources_n = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    left, capped = float(total), 0
    while capped < sources_n:
        level = left / open_weight
        above = F.col("full") < F.col("weight") * level
        taken, open_weight, now = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("full"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.count_if(above)).first()
        left = total - taken
        if now == capped:
            break
        capped = now
    share = F.col("weight") * (left / open_weight) if sources_n and open_weight else F.col("full")
    return weighed.withColumn("target", F.least("full", share)).drop("weight", "full")


def source_rates(tokens: Column, target: Column, size: Column, mu: list[float], cap: float) -> Column:
    """The bands' rates of a source that meet its target: its own multiplier is solved by steps on the log of what is taken."""
    tilt = [F.lit(math.exp(x)) for x in mu]
    taken = lambda scale: sum((F.get(tokens, F.lit(b)) * F.least(scale * tilt[b], F.lit(cap)) for b in range(BANDS)), F.lit(0.0))
    step = lambda scale, _: F.least(scale * target / taken(scale), F.lit(1e30))
    scale = F.aggregate(F.sequence(F.lit(1), F.lit(_INNER)), F.lit(1.0), step)
    free = F.transform(F.array(scale), lambda x: F.array(*[F.least(x * tilt[b], F.lit(cap)) for b in range(BANDS)]))
    all_ = lambda value: F.array_repeat(F.lit(value), BANDS)
    return F.when((size <= 0) | (target <= 0), all_(0.0)).when(target >= size * (cap - 1e-9), all_(float(cap))).otherwise(F.get(free, F.lit(0)))


def balance(goals: DataFrame, *, cap: float = CAP, ridge: float = RIDGE) -> DataFrame:
    """``goals`` (of ``targets``) with ``rates`` by band: the solution of the dual.

    A rate within 1e-9 of a whole number is that number.  Sources without tokens or targets have rates of 0, those at
    ``cap`` times their size rates of ``cap``.
    """
    total, every = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.array(*[F.coalesce(F.sum(F.get("tokens", F.lit(b))), F.lit(0.0)) for b in range(BANDS)])).first()
    whole = sum(every)
    mu = [0.0] * BANDS
    if whole > 0 and total > 0:
        goal, firm = np.array(every) * (total / whole), ridge * total
        for _ in range(NEWTON_STEPS):
            rated = goals.withColumn("rates", source_rates(F.col("tokens"), F.col("target"), F.col("source_size"), mu, cap))
            taken = [F.get("tokens", F.lit(b)) * F.get("rates", F.lit(b)) for b in range(BANDS)]
            moves = [F.when(F.get("rates", F.lit(b)) < cap, taken[b]).otherwise(0.0) for b in range(BANDS)]
            own = sum(moves, F.lit(0.0))
            cross = [F.when(own > 0, moves[a] * moves[b] / own).otherwise(0.0) for a in range(BANDS) for b in range(a + 1)]
            sums = rated.agg(*[F.sum(c).alias(f"c{k}") for k, c in enumerate([*taken, *moves, *cross])]).first()
            gradient = np.array(sums[:BANDS]) - goal + firm * np.array(mu)
            if np.abs(gradient).max() <= NEAR * total:
                break
            hessian = np.diag(np.array(sums[BANDS : 2 * BANDS]) + firm)
            for (a, b), x in zip(((a, b) for a in range(BANDS) for b in range(a + 1)), sums[2 * BANDS :], strict=True):
                hessian[a, b] -= x
                hessian[b, a] -= x if a != b else 0
            step = np.linalg.solve(hessian, gradient)
            mu = (np.array(mu) - step / max(1.0, np.abs(step).max())).tolist()
    rates = source_rates(F.col("tokens"), F.col("target"), F.col("source_size"), mu, cap)
    return goals.withColumn("rates", F.transform(rates, lambda r: F.when(F.abs(r - F.round(r)) < 1e-9, F.round(r)).otherwise(r)))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 17) -> DataFrame:
    """``(id_col, size, source_size, target, rate, copies, taken)`` for every row of ``docs``.

    ``copies`` is 0 to ``cap``; ``taken`` is ``copies * size``.  Null and blank texts have size 0 and take
    nothing; null sources form one source of their own; repeated rows count as often as they occur and are
    rounded one by one.  An empty table gives no rows.  Reruns agree: order is by size, keyed hash and id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col).cast("string")).alias("size"))
    docs = saved(docs.withColumn("key", F.xxhash64(F.lit(seed), "id")))
    goals = balance(targets(docs, weights=weights, cap=cap), cap=cap)
    salts = math.ceil(docs.count() / CELL_ROWS) or 1

    ordered = Window.partitionBy("source").orderBy(F.desc("size"), F.desc("key"), F.desc("id"))
    cut = docs.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= LARGEST)
    cut = cut.groupBy("source").agg(F.min(F.struct("size", "key", "id")).alias("cut"))
    goals = saved(goals.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source"))).select("g.source", "source_size", "target", "rates", "cut"))
    rows = docs.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "source_size", "target", "rates", "cut")
    is_top = F.struct("size", "key", "id") >= F.col("cut")

    # The largest: a fold over at most LARGEST documents a source, each nearest to the running goal.
    def take(state: Column, doc: Column) -> Column:
        rate = F.get("rates", band_of(doc["size"]))
        due = state["due"] + rate * doc["size"]
        n = F.when(doc["size"] > 0, F.round((due - state["taken"]) / doc["size"])).otherwise(F.round(rate))
        n = F.least(F.greatest(n, F.floor(rate)), F.ceil(rate)).cast("int")
        entry = F.struct(doc["size"].alias("size"), doc["key"].alias("key"), doc["id"].alias("id"), rate.alias("rate"), n.alias("copies"))
        return F.struct(due.alias("due"), (state["taken"] + n * doc["size"]).cast("double").alias("taken"), F.array_append(state["out"], entry).alias("out"))

    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("taken"), F.array().cast("array<struct<size:bigint,key:bigint,id:bigint,rate:double,copies:int>>").alias("out"))
    top = rows.filter(is_top).groupBy("source", "source_size", "target", "rates").agg(F.sort_array(F.collect_list(F.struct("size", "key", "id")), asc=False).alias("largest"))
    top = saved(top.withColumn("fold", F.aggregate("largest", start, take)))
    large = top.select("source_size", "target", F.inline("fold.out")).select("id", "size", "source_size", "target", "rate", "copies")

    # The others: positions along (size class, salt, size), from the rates of cells and ranks within them.
    due = F.col("target") - F.col("fold.due")
    right = F.when(due > 0, F.greatest((F.col("target") - F.col("fold.taken")) / due, F.lit(0.0))).otherwise(F.lit(1.0))
    others = rows.filter(~is_top).alias("o").join(top.select("source", right.alias("right")).alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    rate = F.get("rates", band_of(F.col("size")))
    others = others.select(
        "o.id", "o.source", "size", "o.key", "source_size", "target", rate.alias("rate"), F.least(rate * F.col("right"), F.lit(float(cap))).alias("own_rate"),
        class_of(F.col("size")).alias("class"), F.pmod("key", F.lit(salts)).cast("int").alias("salt"),
    )
    cell = ["source", "class", "salt"]
    counts = others.groupBy(*cell).agg(F.sum("own_rate").alias("n"))
    ahead = Window.partitionBy("source").orderBy(F.desc("class"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0.0)))
    within = Window.partitionBy(*cell).orderBy(F.desc("size"), "key", "id")
    placed = others.withColumn("rank", F.row_number().over(within)).alias("p").join(
        counts.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.class") == F.col("k.class")) & (F.col("p.salt") == F.col("k.salt"))
    )
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("p.source")), F.lit(1 << 20)) / float(1 << 20)
    passed = lambda rank: F.floor(F.round(F.col("ahead") + F.col("own_rate") * rank + shift, 6))
    copies = F.least(passed(F.col("rank")) - passed(F.col("rank") - 1), F.lit(math.floor(cap)))
    small = placed.select("id", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))

    out = large.unionByName(small)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``plan`` takes it."""
    chosen = plan(docs, id_col=id_col, **options).filter("copies > 0")
    own, lists, times, time = (unused(docs, c) for c in ("own_id", "copies_of", "times", "time"))
    taken = chosen.groupBy(F.col(id_col).alias(own)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(lists))
    nth = F.row_number().over(Window.partitionBy(own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    joined = docs.join(taken, F.col(id_col).cast("long").eqNullSafe(F.col(own))).withColumn(times, F.get(lists, nth - 1))
    each = F.explode(F.sequence(F.lit(1), F.col(times)))
    return joined.filter(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], each.alias(time)).drop(time)
