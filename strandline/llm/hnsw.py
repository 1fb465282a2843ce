"""Embedding near-duplicates over one navigable small-world graph per shard.

Equal vectors are one point with a count. Points are dealt into shards, and each shard's points become a
layered graph. A point within the threshold of one in the graph is no node of its own but hangs on that
one, its leader, so a group of copies however large takes one place in the beams. Of two shards the queries
of one are searched in the graph of the other, so every shard meets every query, once for each pair of
points. A search keeps a beam of the best nodes seen and goes on from every node that may lead to a link,
however many there are; what hangs on those is compared point by point. Of every block of queries some,
chosen by hash, are audited against all points of the shard; where one of them has found too few of its
neighbours the beam is widened and the shard's earlier blocks are searched again (a beam as wide as the
shard is a full scan). Pairs found are checked by cosine in double precision and count for both ends;
links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components


@dataclass(frozen=True)
class NearConfig:
    threshold: float = 0.9
    #: Shards at least; with more points than that, as many as shard_points asks for.
    shards: int = 12
    shard_points: int = 200_000
    #: Points of one query block, and query points of one task.
    block: int = 512
    part_points: int = 250_000
    neighbours: int = 12
    build_beam: int = 40
    beam: int = 24
    #: Audited queries of a block and of a shard's first one; the share of its neighbours, itself left
    #: out, that those with neighbours must find: on average in each block, and every single one.
    audit: int = 32
    first_audit: int = 100
    recall: float = 0.99
    worst: float = 0.8


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is taken out first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """A layered navigable small-world graph of unit vectors; ``x`` are its nodes, the leaders."""

    def __init__(self, points: np.ndarray, config: NearConfig):
        self.config, self.all = config, points.astype(np.float32)
        n = len(points)
        r = np.random.default_rng(7)
        self.level = np.minimum((-np.log(r.random(n) + 1e-300) / np.log(config.neighbours)).astype(int), 6)
        if n:
            self.level[0] = max(1, self.level.max())  # the first point is the entry, on every layer
        self.width = 2 * config.neighbours
        self.near = [np.full((n, self.width), -1, dtype=np.int32) for _ in range(int(self.level.max(initial=0)) + 1)]
        self.x, self.lead, self.size = np.empty_like(self.all), np.full(n, -1), 0
        leader = np.full(n, -1)
        done = 0
        while done < n:  # a batch is placed at once, by searching what stands already
            batch = np.arange(done, min(n, max(32, 2 * done), done + 1024))
            self._place(batch, leader)
            done = int(batch[-1]) + 1
        self.x, self.lead = self.x[: self.size], self.lead[: self.size]
        # What hangs on each leader, in one list.
        hung = np.setdiff1d(np.arange(n), self.lead)
        self.hung = hung[np.argsort(leader[hung], kind="stable")]
        self.start = np.searchsorted(leader[self.hung], np.arange(self.size + 1))
        # Twice the angle of the threshold: no point that hangs on a leader further off is in reach.
        far = 2 * config.threshold**2 - 1
        self.floor = np.where(np.diff(self.start) > 0, np.float32(far - 1e-4), np.float32(config.threshold - 1e-4))

    def _set(self, layer: int, i: int, others: np.ndarray) -> None:
        """Neighbours of a point: near ones, but none nearer to a chosen one than to the point."""
        if len(others) > self.width:
            sims = self.x[others] @ self.x[i]
            others = others[np.argsort(-sims, kind="stable")]
            sims = np.sort(sims)[::-1]
            among = self.x[others] @ self.x[others].T
            chosen: list[int] = []
            for k in range(len(others)):
                if not chosen or among[k, chosen].max() < sims[k]:
                    chosen.append(k)
                if len(chosen) == self.width:
                    break
            rest = [k for k in range(len(others)) if k not in set(chosen)][: self.width - len(chosen)]
            others = others[chosen + rest]
        self.near[layer][i] = -1
        self.near[layer][i, : len(others)] = others

    def _place(self, batch: np.ndarray, leader: np.ndarray) -> None:
        """Hang points on leaders in reach; the others become leaders and nodes of the graph."""
        q, top = self.all[batch], len(self.near) - 1
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if self.size:
            entry = np.zeros(len(batch), dtype=np.int64)
            for layer in range(top, -1, -1):
                ids, sims, _, _ = self._search(q, entry, self.config.build_beam, layer)
                found[layer], entry = (ids, sims), ids[:, 0]
            near = found[0][1][:, 0] >= self.config.threshold
            leader[batch[near]] = found[0][0][near, 0]
        new: list[int] = []
        among = q @ q.T >= self.config.threshold
        for i in np.flatnonzero(leader[batch] < 0).tolist():
            if leader[batch[i]] < 0:  # not taken by one before it in the batch
                leader[batch[among[i] & (leader[batch] < 0)]] = self.size + len(new)
                new.append(i)
        at = np.arange(self.size, self.size + len(new))
        self.x[at], self.lead[at] = q[new], batch[new]
        self.size += len(new)
        if not found:
            for layer in range(top + 1):
                mine = at[self.level[at] >= layer]
                for i in mine.tolist():
                    self._set(layer, i, mine[mine != i])
            return
        for layer in range(top, -1, -1):
            on = np.flatnonzero(self.level[at] >= layer)
            if len(on):
                self._link(layer, at[on], found[layer][0][new][on], found[layer][1][new][on])

    def _link(self, layer: int, at: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Links of new nodes with the candidates of their searches, in both directions."""
        v = self.x[np.maximum(cand, 0)]
        among = v @ v.transpose(0, 2, 1)
        best = np.full(cand.shape, -2.0, dtype=np.float32)  # nearest chosen one of each candidate
        chosen = np.zeros(cand.shape, dtype=bool)
        for k in range(cand.shape[1]):
            take = (cand[:, k] >= 0) & (best[:, k] < sim[:, k]) & (chosen.sum(1) < self.config.neighbours)
            chosen[take, k] = True
            best[take] = np.maximum(best[take], among[take, k])
        back: dict[int, list[int]] = {}
        for row, i in enumerate(at.tolist()):
            mine = cand[row][chosen[row]]
            if len(mine) < self.config.neighbours:  # near ones fill up
                rest = cand[row][~chosen[row] & (cand[row] >= 0)][: self.config.neighbours - len(mine)]
                mine = np.concatenate([mine, rest])
            self.near[layer][i, : len(mine)] = mine
            for j in mine.tolist():
                back.setdefault(j, []).append(i)
        for j, more in back.items():
            old = self.near[layer][j]
            self._set(layer, j, np.concatenate([old[old >= 0], np.array(more, dtype=np.int64)]))

    def _search(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, floor: np.ndarray | None = None):
        """Beams of all queries at once: nodes and similarities, best first, and all pairs over the nodes' ``floor``."""
        x, near, rows = self.x, self.near[layer], np.arange(len(q))
        seen = np.zeros((len(q), self.size), dtype=bool)
        seen[rows, entry] = True
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(q), beam), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, (q * x[entry]).sum(1), True
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        if floor is not None:
            over = sims[:, 0] >= floor[entry]
            hits.append((rows[over], entry[over]))
        extra_row, extra_id = np.zeros(0, np.int64), np.zeros(0, np.int64)  # over the floor, outside the beam
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live) and not len(extra_row):
                return ids, sims, np.concatenate([h[0] for h in hits]) if hits else None, np.concatenate([h[1] for h in hits]) if hits else None
            take = min(3, beam)
            score = np.where(open_[live], sims[live], -np.inf)
            pick = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < beam else np.tile(np.arange(beam), (len(live), 1))
            ok = np.take_along_axis(open_[live], pick, 1)
            open_[np.repeat(live, pick.shape[1]), pick.reshape(-1)] = False
            from_row = np.concatenate([np.repeat(live, pick.shape[1])[ok.reshape(-1)], extra_row])
            from_id = np.concatenate([np.take_along_axis(ids[live], pick, 1)[ok], extra_id])
            row, to = np.repeat(from_row, self.width), near[from_id].reshape(-1).astype(np.int64)
            keep = to >= 0
            row, to = row[keep], to[keep]
            keep = ~seen[row, to]
            cell = np.unique(row[keep] * self.size + to[keep])
            row, to = cell // self.size, cell % self.size
            seen[row, to] = True
            sim = np.einsum("ij,ij->i", q[row], x[to])
            over = np.zeros(len(row), dtype=bool)
            if floor is not None:
                over = sim >= floor[to]
                hits.append((row[over], to[over]))
            extra_row, extra_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if not len(row):
                continue
            touched, first, count = np.unique(row, return_index=True, return_counts=True)
            column = np.arange(len(row)) - np.repeat(first, count)
            wide = int(count.max())
            new_ids = np.full((len(touched), wide), -1, dtype=np.int64)
            new_sims = np.full((len(touched), wide), -np.inf, dtype=np.float32)
            place = np.repeat(np.arange(len(touched)), count)
            new_ids[place, column], new_sims[place, column] = to, sim
            all_ids = np.concatenate([ids[touched], new_ids], axis=1)
            all_sims = np.concatenate([sims[touched], new_sims], axis=1)
            all_open = np.concatenate([open_[touched], new_ids >= 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")
            if floor is not None:  # what falls out of the beam is gone on from nevertheless, if over the floor
                out = order[:, beam:]
                lost = np.take_along_axis(all_open, out, 1) & (np.take_along_axis(all_sims, out, 1) >= floor[np.take_along_axis(all_ids, out, 1)])
                extra_row, extra_id = np.repeat(touched, out.shape[1])[lost.reshape(-1)], np.take_along_axis(all_ids, out, 1)[lost]
            order = order[:, :beam]
            ids[touched] = np.take_along_axis(all_ids, order, 1)
            sims[touched] = np.take_along_axis(all_sims, order, 1)
            open_[touched] = np.take_along_axis(all_open, order, 1)

    def over(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) of about the threshold or more that the search comes across."""
        least = np.float32(self.config.threshold - 1e-4)
        if beam >= self.size:
            return np.nonzero(q @ self.all.T >= least)
        entry = np.zeros(len(q), dtype=np.int64)
        for layer in range(len(self.near) - 1, 0, -1):
            entry = self._search(q, entry, 1, layer)[0][:, 0]
        _, _, row, node = self._search(q, entry, beam, 0, self.floor)
        near = np.einsum("ij,ij->i", q[row], self.x[node]) >= least
        out = [(row[near], self.lead[node[near]])]
        row, node = (a[self.start[node + 1] > self.start[node]] for a in (row, node))
        order = np.argsort(node, kind="stable")
        row, node = row[order], node[order]
        for some in np.split(np.arange(len(node)), np.flatnonzero(np.diff(node)) + 1):
            if len(some):  # the queries that came across one leader, with all that hangs on it
                hung = self.hung[self.start[node[some[0]]] : self.start[node[some[0]] + 1]]
                for at in range(0, len(hung), 8192):
                    r, c = np.nonzero(q[row[some]] @ self.all[hung[at : at + 8192]].T >= least)
                    out.append((row[some][r], hung[at : at + 8192][c]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked within these pairs), without the smallest themselves."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class _Shard:
    """One shard's graph and what the queries of one part have found in it so far."""

    def __init__(self, points: list[tuple[int, int, np.ndarray]], config: NearConfig):
        self.config = config
        self.exact = _unit(np.stack([p[2] for p in points]).astype(np.float64))
        self.ids, self.weights = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        self.graph, self.beam = Graph(self.exact, config), config.beam
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.asked, self.share, self.least = 0, 0.0, 1.0
        self._forget()

    def _forget(self) -> None:
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.gained = np.zeros(len(self.ids), dtype=np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def search(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        """One block of queries: audit, widen if asked for, then find its links."""
        ids, weights, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), _unit(np.stack([r[2] for r in rows]).astype(np.float64))
        # Rows come in the order of a hash, so the first are a fair sample of the block.
        n = self.config.audit if self.blocks else self.config.first_audit
        some = q[:n].astype(np.float32)
        near = (some @ self.graph.all.T >= np.float32(self.config.threshold - 1e-4)) & (ids[:n, None] != self.ids[None])
        true, before = near.sum(1), self.beam
        while True:
            row, to = self.graph.over(some, self.beam)
            share = (np.bincount(row[near[row, to]], minlength=len(some)) / np.maximum(true, 1))[true > 0]
            if self.beam >= self.graph.size or not len(share) or (share.mean() >= self.config.recall and share.min() >= self.config.worst):
                break
            self.beam *= 2
        self.asked, self.share, self.least = self.asked + len(share), self.share + share.sum(), min(self.least, share.min(initial=1.0))
        if self.beam > before and self.blocks:  # a narrower beam may have missed links of the blocks before
            self._forget()
            for block in self.blocks:
                self._find(*block)
        self.blocks.append((ids, weights, q))
        self._find(ids, weights, q)

    def _find(self, ids: np.ndarray, weights: np.ndarray, q: np.ndarray) -> None:
        row, to = self.graph.over(q.astype(np.float32), self.beam)
        good = np.zeros(len(row), dtype=bool)
        for at in range(0, len(row), 100_000):
            s = slice(at, at + 100_000)
            good[s] = np.einsum("ij,ij->i", q[row[s]], self.exact[to[s]]) >= self.config.threshold
        # In its own shard a pair comes across from both ends; it counts from the smaller one.
        own = np.isin(ids, self.ids)
        good &= np.where(own[row], ids[row] < self.ids[to], True)
        row, to = row[good], to[good]
        counts = np.bincount(row, weights=self.weights[to], minlength=len(ids)).astype(np.int64)
        self.counts.append((ids[counts > 0], counts[counts > 0]))
        self.gained += np.bincount(to, weights=weights[row], minlength=len(self.ids)).astype(np.int64)
        if len(row):
            self.links.append(_labels(ids[row], self.ids[to]))
            self.waiting += len(self.links[-1][0])
            if self.waiting > 2_000_000:
                self.links = [_labels(*(np.concatenate([x[i] for x in self.links]) for i in (0, 1)))]
                self.waiting = len(self.links[0][0])

    def out(self) -> Iterator[pa.RecordBatch]:
        """Rows (kind, node, value, share): 0 links of a node, 1 a link of components, 2 audited queries with what they found."""
        kept = np.flatnonzero(self.gained)
        parts = [(0, ids, counts) for ids, counts in self.counts] + [(0, self.ids[kept], self.gained[kept])] + [(1, a, b) for a, b in self.links]
        for kind, node, value in parts:
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), kind)), pa.array(node), pa.array(value), pa.nulls(len(node), pa.float64()), pa.nulls(len(node), pa.float64())], names=["kind", "node", "value", "share", "least"])
        yield pa.RecordBatch.from_arrays([pa.array([2]), pa.nulls(1, pa.int64()), pa.array([self.asked]), pa.array([float(self.share)]), pa.array([float(self.least)])], names=["kind", "node", "value", "share", "least"])


def _task(batches: Iterator[pa.RecordBatch], config: NearConfig) -> Iterator[pa.RecordBatch]:
    """Rows of some (shard, part) keys in order; of each key first the shard's points, then queries."""
    key, points, queries = None, [], []
    shard: _Shard | None = None

    def search() -> None:
        nonlocal shard, queries
        if queries:
            shard = shard or _Shard(points, config)
            shard.search(queries)
            queries = []

    for batch in batches:
        vectors = batch.column(4).to_pylist()
        for k, query, node, weight, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), vectors):
            if k != key:
                search()
                if shard:
                    yield from shard.out()
                key, points, shard = k, [], None
            if query:
                if points:  # a shard may have no points of that length
                    queries.append((node, weight, np.array(v)))
                # Memory of what was seen grows with points times queries.
                if len(queries) >= max(16, min(config.block, 32_000_000 // max(1, len(points)))):
                    search()
            else:
                points.append((node, weight, np.array(v)))
    search()
    if shard:
        yield from shard.out()


def near_duplicates(vectors: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept, audit_recall, audit_worst.

    The last two are the same in all rows: the share of their neighbours that audited queries found, as the
    mean, and the least of a single one (null where no audited query had a neighbour).

    A vector that is null, empty, zero or has a null or non-finite component links with nothing and
    is its own component. Only vectors of one length are compared. Equal vectors link with each other.
    Rows that share a vec_id count as one vector where their embeddings are equal, and as linked
    where not. Labels and other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    points = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    points = materialize(points, "points")
    total = points.count()
    shards = max(config.shards, -(-total // config.shard_points))
    parts = max(1, -(-total // config.part_points))
    of_node = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(n))
    # Key: the vectors' length, shard and part of the queries. A part's task holds one shard at a time.
    stored = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.size("v").alias("d"), of_node(shards, 1).alias("shard"), F.col("part").cast("long").alias("part"), F.lit(False).alias("query"), "node", "weight", "v")
    # Of two shards the queries of one meet the graph of the other: which one goes by the parity of their sum.
    own = of_node(shards, 1)
    meets = lambda j: (j == own) | ((own < j) == ((own + j) % 2 == 1))
    asked = points.withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), meets))).select(F.size("v").alias("d"), F.col("shard").cast("long").alias("shard"), of_node(parts, 2).alias("part"), F.lit(True).alias("query"), "node", "weight", "v")
    keyed = stored.unionByName(asked).select(((F.col("d").cast("long") * shards + F.col("shard")) * parts + F.col("part")).alias("key"), "query", "node", "weight", "v")
    dealt = keyed.repartitionByRange(shards * parts, "key").sortWithinPartitions("key", "query", F.xxhash64("node", F.lit(3)), "node")
    found = materialize(dealt.mapInArrow(lambda it: _task(it, config), "kind bigint, node bigint, value bigint, share double, least double"), "links")
    counts = found.where(F.col("kind") == 0).groupBy("node").agg(F.sum("value").alias("found"))
    comp = components(found.where(F.col("kind") == 1).select(F.col("node").alias("a"), F.col("value").alias("b")))
    of_point = points.join(counts, "node", "left").join(comp, "node", "left").select("v", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    # Vectors that link with nothing need no join; they would all meet under null.
    linked = rows.where(F.col("v").isNotNull()).join(of_point, "v").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    audit = found.where("kind = 2 AND value > 0").agg((F.sum("share") / F.sum("value")).alias("mean"), F.min("least").alias("least")).first()
    done = linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return done.withColumns({"audit_recall": F.lit(audit["mean"]).cast("double"), "audit_worst": F.lit(audit["least"]).cast("double")})
