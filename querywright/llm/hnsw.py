"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are dealt to shards; one graph is built for each shard, and every vector queries every shard: a task holds
two shards and searches each with the vectors of the other, so a link found from either end counts for both.
Beams widen until a vector's beam reaches below the threshold, and for a whole task until an audit, in which sampled
queries are compared with all vectors of the shard, finds the wanted recall of links.  Vectors with more links than beams are
good for (members of a large group) are compared with the whole shard, exactly.  Links are verified
by cosine in double precision.  A task returns how many links each of its vectors has and a spanning
forest of its links, never all pairs, and components are found over those forests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, components, mix, saved

SHARDS = 8
#: A task holds two shards: at most so many vectors, and bytes of their numbers, each.
SHARD_ROWS = 1 << 16
SHARD_BYTES = 64 << 20
DEGREE = 12
BEAM = 32
BUILD_BEAM = 48
#: An audit samples from so many queries to so many, until it has seen so many true links.
AUDIT_QUERIES, AUDIT_MOST, AUDIT_LINKS = 64, 4096, 200
#: A beam that is full at this width is given up for a comparison with the whole shard.
HEAVY = 256
RECALL = 0.99
_STEP = 4
_CHUNK = 512


class Graph:
    """Layers from the bottom up: members, their neighbours (-1: none), and each vector's row among the members."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, degree: int = DEGREE) -> Graph:
        """Levels come from a hash of the id; layers are built from the top, each entered through those above."""
        self = cls(x)
        chance = np.maximum((mix(ids.astype(U)) >> U(11)).astype(float) / 2.0**53, 1e-18)
        level = np.minimum(-np.log(chance) / math.log(degree), 12).astype(int)
        top = int(level.max(initial=0))
        for k in range(top, -1, -1):
            members = np.flatnonzero(level >= k)
            row = np.full(len(x), -1)
            row[members] = np.arange(len(members))
            neighbours = np.full((len(members), degree * (2 if k == 0 else 1)), -1)
            self.layers.insert(0, (members, neighbours, row))
            self._fill(members, neighbours, row)
        return self

    def _fill(self, members: np.ndarray, neighbours: np.ndarray, row: np.ndarray) -> None:
        done = 0
        while done < len(members):
            fresh = members[done : done + min(max(done, 64), _CHUNK)]
            q = self.x[fresh]
            among = q @ q.T
            np.fill_diagonal(among, -np.inf)
            take = min(BUILD_BEAM, len(fresh))
            near = np.argpartition(-among, take - 1, axis=1)[:, :take]
            ids, sims = fresh[near], np.take_along_axis(among, near, 1)
            if done:
                old, old_sims = self._beam(q, self._enter(q, members[:done]), 0, BUILD_BEAM)
                ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, old_sims], 1)
            sims = np.where(ids < 0, -np.inf, sims)
            order = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            neighbours[done : done + len(fresh)] = self._select(ids, sims, neighbours.shape[1])
            self._back(fresh, neighbours, row)
            done += len(fresh)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: candidates, best first, nearer to the vector than to any chosen one; the best others fill up."""
        c = self.x[np.maximum(ids, 0)]
        pair = np.einsum("ikd,ijd->ikj", c, c)
        chosen = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), int)
        for k in range(ids.shape[1]):
            closest = np.where(chosen, pair[:, k, :], -np.inf).max(axis=1)
            good = np.isfinite(sims[:, k]) & (closest < sims[:, k]) & (count < most)
            chosen[:, k] = good
            count += good
        rank = np.where(chosen, 0, 1) * ids.shape[1] + np.arange(ids.shape[1])
        rank = np.where(np.isfinite(sims), rank, 1 << 30)
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.full((len(ids), most), -1)
        kept = np.where(np.take_along_axis(rank, order, 1) < 1 << 30, np.take_along_axis(ids, order, 1), -1)
        out[:, : kept.shape[1]] = kept
        return out

    def _back(self, fresh: np.ndarray, neighbours: np.ndarray, row: np.ndarray) -> None:
        own = neighbours[row[fresh]]
        src, dst = np.repeat(fresh, own.shape[1]), own.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        if not len(dst):
            return
        head = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        for a, b in zip(head, np.append(head[1:], len(dst)), strict=True):
            v = dst[a]
            have = neighbours[row[v]]
            have = have[have >= 0]
            both = np.concatenate([have, np.setdiff1d(src[a:b], have)])
            if len(both) > neighbours.shape[1]:
                sims = self.x[both] @ self.x[v]
                order2 = np.argsort(-sims)[:BUILD_BEAM]
                both = self._select(both[order2][None], sims[order2][None], neighbours.shape[1])[0]
            neighbours[row[v], : len(both)] = both

    def _enter(self, q: np.ndarray, ready: np.ndarray) -> np.ndarray:
        """For each query a vector near it, by greedy descent through the layers above the lowest one present."""
        at = np.full(len(q), ready[0] if len(self.layers) == 1 else self.layers[-1][0][0])
        sim = np.einsum("qd,qd->q", q, self.x[at])
        for members, neighbours, row in reversed(self.layers[1:]):
            live = np.arange(len(q))
            while len(live):
                near = neighbours[row[at[live]]]
                s = np.where(near >= 0, np.einsum("qkd,qd->qk", self.x[np.maximum(near, 0)], q[live]), -np.inf)
                best = s.argmax(axis=1)
                value = s[np.arange(len(live)), best]
                better = value > sim[live]
                live, near, best, value = live[better], near[better], best[better], value[better]
                at[live], sim[live] = near[np.arange(len(live)), best], value
        if len(ready) < len(self.layers[0][0]):  # while a layer is filled, only its ready members can be entered
            at = np.where(np.isin(at, ready), at, ready[0])
        return at

    def _beam(self, q: np.ndarray, enter: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best vectors met by beam search from ``enter``: ids (-1: none) and similarities."""
        _, neighbours, row = self.layers[layer]
        n = len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, width), -1)
        sims = np.full((n, width), -np.inf, self.x.dtype)
        open_ = np.zeros((n, width), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = enter, np.einsum("qd,qd->q", q, self.x[enter]), True
        seen[np.arange(n), enter] = True
        live = np.arange(n)
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            step = min(_STEP, width)
            pick = np.argpartition(-score, step - 1, axis=1)[:, :step] if step < width else np.tile(np.arange(width), (len(live), 1))
            real = np.take_along_axis(open_[live], pick, 1)
            chosen = np.where(real, np.take_along_axis(ids[live], pick, 1), -1)
            state = open_[live]
            np.put_along_axis(state, pick, False, 1)
            near = np.where(chosen[:, :, None] >= 0, neighbours[row[np.maximum(chosen, 0)]], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            twice = np.zeros(near.shape, bool)
            twice[:, 1:] = near[:, 1:] == near[:, :-1]
            safe = np.maximum(near, 0)
            use = (near >= 0) & ~twice & ~seen[live[:, None], safe]
            r, c = np.nonzero(use)
            target = near[r, c]
            seen[live[r], target] = True
            s = np.full(near.shape, -np.inf, self.x.dtype)
            s[r, c] = np.einsum("kd,kd->k", self.x[target], q[live[r]])
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([state, use], 1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(sims[live])
            live = live[open_[live].any(axis=1)]
        return np.where(np.isfinite(sims), ids, -1), sims

    def near(self, q: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, vector) of at least ``threshold``, and the queries with too many: a beam that holds nothing else is doubled up to ``HEAVY``."""
        found_q, found_v, heavy = [], [], []
        size = max(1, min(_CHUNK, (64 << 20) // max(len(self.x), 1)))
        ready = self.layers[0][0]
        for a in range(0, len(q), size):
            part = np.arange(a, min(a + size, len(q)))
            enter = self._enter(q[part], ready)
            beam = min(width, len(self.x))
            while len(part):
                ids, sims = self._beam(q[part], enter, 0, beam)
                full = (ids >= 0).all(axis=1) & (sims.min(axis=1) >= threshold) & (beam < len(self.x))
                r, c = np.nonzero((sims >= threshold) & ~full[:, None] & (ids >= 0))
                found_q.append(part[r])
                found_v.append(ids[r, c])
                part, enter = part[full], enter[full]
                if beam >= max(HEAVY, width):
                    heavy.append(part)
                    break
                beam = min(2 * beam, len(self.x))
        none = np.zeros(0, int)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_v]), np.concatenate([none, *heavy])

    def packed(self) -> tuple[np.ndarray, pa.Array]:
        """Of each vector the number of its layers, and its neighbours in all of them, from the lowest up."""
        levels = np.zeros(len(self.x), np.int32)
        for members, _, _ in self.layers:
            levels[members] += 1
        wide, slim = 2 * DEGREE, DEGREE
        offsets = np.concatenate([[0], np.cumsum(wide + slim * (levels.astype(np.int64) - 1))])
        flat = np.full(int(offsets[-1]), -1, np.int32)
        for k, (members, neighbours, _) in enumerate(self.layers):
            at = offsets[members] + (0 if k == 0 else wide + slim * (k - 1))
            flat[at[:, None] + np.arange(neighbours.shape[1])] = neighbours
        return levels, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))

    @classmethod
    def unpacked(cls, x: np.ndarray, levels: np.ndarray, flat: np.ndarray) -> Graph:
        self = cls(x)
        wide, slim = 2 * DEGREE, DEGREE
        offsets = np.concatenate([[0], np.cumsum(wide + slim * (levels.astype(np.int64) - 1))])
        for k in range(int(levels.max(initial=0))):
            members = np.flatnonzero(levels > k)
            row = np.full(len(x), -1)
            row[members] = np.arange(len(members))
            at = offsets[members] + (0 if k == 0 else wide + slim * (k - 1))
            self.layers.append((members, flat[at[:, None] + np.arange(wide if k == 0 else slim)].astype(np.int64), row))
        return self


def sampled_links(x: np.ndarray, q: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sampled queries and their true links among ``x``: more are sampled until enough links are seen.  ``own``: query k is vector k, no link of its."""
    size = min(AUDIT_QUERIES, len(q))
    while True:
        chosen = np.unique(np.linspace(0, len(q) - 1, size).astype(int)) if size else np.zeros(0, int)
        true = q[chosen] @ x.T >= threshold
        if own:
            true[np.arange(len(chosen)), chosen] = False
        if size >= min(AUDIT_MOST, len(q)) or true.sum() >= AUDIT_LINKS:
            return chosen, true
        size = min(2 * size, AUDIT_MOST, len(q))


def audited(graph: Graph, q: np.ndarray, threshold: float, *, own: bool = False, width: int = BEAM, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``near``, with beams doubled until sampled queries find the wanted share of their true links, over all and in the mean of the queries."""
    chosen, true = sampled_links(graph.x, q, threshold, own)
    while True:
        a, b, heavy = graph.near(q, threshold, width)
        hit = np.zeros(true.shape, bool)
        if len(chosen):
            at = np.minimum(np.searchsorted(chosen, a), len(chosen) - 1)
            of = chosen[at] == a
            hit[at[of], b[of]] = True
            hit[np.isin(chosen, heavy)] = True
        some = true.any(axis=1)
        each = (hit & true)[some].sum(axis=1) / true[some].sum(axis=1)
        if width >= len(graph.x) or not some.any() or ((hit & true).sum() >= recall * true.sum() and each.mean() >= recall):
            return a, b, heavy
        width *= 2


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class _Links:
    """Links between the vectors of two shards (or within one), as they are found: counts by vector, and which hang together."""

    def __init__(self, x: np.ndarray, y: np.ndarray, same: bool, copies: np.ndarray, threshold: float):
        self.x, self.y, self.same, self.threshold = x, y, same, threshold
        self.nx, self.ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        self.copies, self.count, self.label = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))
        self.shift = 0 if same else len(x)

    def light(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs, each once; verified a block at a time."""
        kept_a, kept_b = [], []
        for k in range(0, len(a), 1 << 18):
            i, j = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            real = np.einsum("kd,kd->k", self.x[i], self.y[j]) / (self.nx[i] * self.ny[j]) >= self.threshold
            kept_a.append(i[real])
            kept_b.append(j[real] + self.shift)
        a, b = np.concatenate([np.zeros(0, int), *kept_a]), np.concatenate([np.zeros(0, int), *kept_b])
        np.add.at(self.count, a, self.copies[b])
        np.add.at(self.count, b, self.copies[a])
        while len(a):
            low = np.minimum(self.label[a], self.label[b])
            before = self.label.copy()
            np.minimum.at(self.label, a, low)
            np.minimum.at(self.label, b, low)
            if (before == self.label).all():
                break

    def heavy(self, rows: np.ndarray, of_x: bool, skip: np.ndarray) -> None:
        """All links of ``rows`` of one side with the other, but with those that ``skip`` marks."""
        q, nq, v, nv = (self.x, self.nx, self.y, self.ny) if of_x else (self.y, self.ny, self.x, self.nx)
        mine, theirs = (0, self.shift) if of_x else (self.shift, 0)
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            hits = (q[part] @ v.T) / (nq[part][:, None] * nv[None, :]) >= self.threshold
            hits[:, skip] = False
            if self.same:
                hits[np.arange(len(part)), part] = False
                # Within one shard a pair of heavy vectors is met from both ends, every other one only here.
                both = np.zeros(len(v), bool)
                both[rows] = True
                self.count += np.where(both, 0, self.copies[part] @ hits)
            else:
                self.count[theirs : theirs + len(v)] += self.copies[part + mine] @ hits
            self.count[part + mine] += hits @ self.copies[theirs : theirs + len(v)]
            for r, h in enumerate((part + mine).tolist()):
                met = np.flatnonzero(hits[r]) + theirs
                found = self.label[met]
                low = min(int(found.min(initial=self.label[h])), int(self.label[h]))
                if (found != low).any() or self.label[h] != low:
                    self.label[np.isin(self.label, np.append(found, self.label[h]))] = low


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, recall: float = RECALL) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row.

    Vectors of equal length with cosine >= ``threshold`` link.  Vectors that are null, empty, zero or hold a null
    or non-finite component link with nothing.  Equal vectors are folded into one before the search and
    count one by one as links.  Rows that repeat an id count as vectors of their own with one component.
    A null id with a good vector is not compared.
    """
    v = F.col(vector_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), (F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).alias("ok"))
    good = rows.filter("ok").withColumn("dim", F.size("v"))
    classes = saved(good.groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    total, widest = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(1, min(max(shards, math.ceil(total / min(shard_rows, max(1, shard_bytes // (8 * widest))))), math.ceil(total / 64)))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        graph = Graph.build(_unit(_matrix(table, "v")), table.column("rep").to_numpy())
        levels, near = graph.packed()
        return table.append_column("place", pa.array(np.arange(len(table), dtype=np.int32))).append_column("levels", pa.array(levels)).append_column("near", near)

    graphs = placed.groupBy("dim", "shard").applyInArrow(build, "dim int, v array<double>, rep long, copies long, shard int, place int, levels int, near array<int>")
    graphs = saved(graphs)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        sides = [table.filter(pc.equal(table.column("shard"), k)).sort_by("place") for k in dict.fromkeys([low, high])]
        if any(not len(t) for t in sides):
            return pa.table({k: pa.array([], pa.int64()) for k in ("id", "n", "root")})
        full = [_matrix(t, "v") for t in sides]
        made = [Graph.unpacked(_unit(x), t.column("levels").to_numpy(), t.column("near").combine_chunks().flatten().to_numpy()) for x, t in zip(full, sides, strict=True)]
        ids, copies = (np.concatenate([t.column(c).to_numpy() for t in sides]) for c in ("rep", "copies"))
        same, least = len(sides) == 1, threshold - 1e-4
        x, y = full[0], full[-1]
        links = _Links(x, y, same, copies, threshold)
        a, b, heavy_x = audited(made[-1], made[0].x, least, own=same, recall=recall)
        if same:
            heavy_y = heavy_x
            a, b = np.minimum(a, b), np.maximum(a, b)
        else:
            d, c, heavy_y = audited(made[0], made[-1].x, least, recall=recall)
            a, b = np.concatenate([a, c]), np.concatenate([b, d])
        is_x, is_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        is_x[heavy_x], is_y[heavy_y] = True, True
        code = np.unique(a * len(y) + b)
        a, b = code // len(y), code % len(y)
        use = ~is_x[a] & ~is_y[b] & ((a != b) if same else True)
        links.light(a[use], b[use])
        links.heavy(heavy_x, True, np.zeros(len(y), bool))
        if not same:
            links.heavy(heavy_y, False, is_x)
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, links.label, ids)
        some = np.flatnonzero(links.count)
        return pa.table({"id": ids[some], "n": links.count[some], "root": root[links.label[some]]})

    other = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    held = graphs.withColumn("other", other).select("*", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high")).drop("other")
    found = saved(held.groupBy("dim", "low", "high").applyInArrow(ask, "id long, n long, root long"))
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    member = good.join(classes, ["dim", "v"]).select("id", "rep", "copies")
    twins = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    part = saved(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(twins.select("low", "high"))))
    placed_rows = member.join(counts, "rep", "left").join(part, member["rep"] == part["id"], "left").select(
        member["id"].alias("id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    bad = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = placed_rows.unionByName(bad)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
