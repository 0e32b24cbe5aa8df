"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

A shard's graph is one row of flat arrays: vectors, levels, and for each level the neighbour lists.
Vectors are inserted in batches: each descends greedily through the upper levels, a beam search on
its own levels gives the candidates, to which those of its batch come, and a heuristic picks
neighbours in different directions. All shards are searched and their results merged. Beams of many
vectors advance together, so that a step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release_heaps, release_worker, require

K = 5
#: Vectors a shard, on average: its graph has to fit in a task's memory.
SHARD = 8192
LINKS = 16
CANDIDATES = 64
BEAM = 96
ENTRIES = 8
BATCH = 256
#: Candidates of a beam that are followed in one step.
STRIDE = 4


def choose(near: np.ndarray, sims: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those nearer to the node than to any chosen one; then the nearest
    of the rest, up to half of `most`."""
    if len(near) <= most // 2:
        return near
    among = unit[near] @ unit[near].T
    free, closest = np.ones(len(near), bool), np.full(len(near), -np.inf, np.float32)
    taken: list[int] = []
    while len(taken) < most:
        fit = np.flatnonzero(free & (sims > closest))
        if not len(fit):
            break
        i = int(fit[0])
        taken.append(i)
        free[: i + 1] = False
        closest = np.maximum(closest, among[i])
    rest = np.setdiff1d(np.arange(len(near)), taken)
    return near[np.append(taken, rest[: max(0, most // 2 - len(taken))]).astype(np.int64)]


class Graph:
    """unit: unit vectors; level: of each; lists[l]: row of neighbours for each node, -1 for none; entry:
    a node of the highest level."""

    def __init__(self, unit: np.ndarray, level: np.ndarray, lists: list[np.ndarray]):
        self.unit, self.level, self.lists = unit, level, lists
        self.entry = int(np.argmax(level))

    @classmethod
    def build(cls, unit: np.ndarray, seed: int, links: int = LINKS, candidates: int = CANDIDATES) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 8)
        # A list may hold `links` neighbours too many until it is thinned out.
        most = [2 * links if layer == 0 else links for layer in range(int(level.max()) + 1)]
        graph = cls(unit, level, [np.full((n, m + links), -1, np.int32) for m in most])
        degree = [np.zeros(n, np.int64) for _ in most]
        graph.entry, start = 0, 1
        while start < n:
            nodes = np.arange(start, min(n, start + min(BATCH, start)))  # no more than are there
            peers = unit[nodes] @ unit[nodes].T
            np.fill_diagonal(peers, -np.inf)
            at = np.full((len(nodes), 1), graph.entry)
            for layer in range(len(most) - 1, -1, -1):
                mine = np.flatnonzero(level[nodes] >= layer)
                if layer <= level[graph.entry]:
                    near, sims = graph.beam(unit[nodes], at, layer, candidates if len(mine) else ENTRIES)
                    at = near[:, :ENTRIES]
                else:
                    near, sims = np.zeros((len(nodes), 0), np.int64), np.zeros((len(nodes), 0), np.float32)
                for i in mine.tolist():
                    among = np.append(near[i], nodes[mine])
                    sim = np.append(sims[i], peers[i, mine])
                    order = np.argsort(-sim, kind="stable")[:candidates]
                    order = order[sim[order] > -np.inf]
                    graph.link(layer, int(nodes[i]), choose(among[order], sim[order], unit, links), most[layer], degree[layer])
            top = int(nodes[np.argmax(level[nodes])])
            if level[top] > level[graph.entry]:
                graph.entry = top
            start = int(nodes[-1]) + 1
        for layer, m in enumerate(most):
            for node in np.flatnonzero(degree[layer] > m).tolist():
                graph.thin(layer, node, m, degree[layer])
            graph.lists[layer] = np.ascontiguousarray(graph.lists[layer][:, :m])
        return graph

    def link(self, layer: int, node: int, near: np.ndarray, most: int, degree: np.ndarray) -> None:
        table = self.lists[layer]
        for a, b in [(node, int(x)) for x in near] + [(int(x), node) for x in near]:
            if b in table[a, : degree[a]]:
                continue
            if degree[a] == table.shape[1]:
                self.thin(layer, a, most, degree)
            table[a, degree[a]] = b
            degree[a] += 1

    def thin(self, layer: int, node: int, most: int, degree: np.ndarray) -> None:
        near = self.lists[layer][node, : degree[node]].astype(np.int64)
        sims = self.unit[near] @ self.unit[node]
        order = np.argsort(-sims, kind="stable")
        kept = choose(near[order], sims[order], self.unit, most)
        self.lists[layer][node] = -1
        self.lists[layer][node, : len(kept)] = kept
        degree[node] = len(kept)

    def beam(self, q: np.ndarray, entries: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the best `width` nodes found from its entries, best first (-1 for none), and
        their similarities (-inf). A row is done when all of its best nodes have been followed."""
        table, unit, n = self.lists[layer], self.unit, len(q)
        seen = np.zeros((n, len(unit) + 1), bool)  # the last column is for -1
        stamp = np.zeros((n, len(unit) + 1), np.int32)
        ids, sims, ahead = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        rows, near = np.arange(n), entries
        while True:
            # Of nodes that are met the first time, and once in this step, the similarities.
            row = rows[:, None]
            stamp[row, near] = np.arange(near.shape[1])
            fresh = (near >= 0) & ~seen[row, near] & (stamp[row, near] == np.arange(near.shape[1]))
            seen[row, near] = True
            r, c = np.nonzero(fresh)
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", unit[near[r, c]], q[rows[r]])
            every = np.concatenate([sims[rows], sim], 1)
            best = np.argpartition(-every, width - 1, 1)[:, :width]
            at = np.arange(len(rows))[:, None]
            sims[rows] = every[at, best]
            ids[rows] = np.concatenate([ids[rows], np.where(fresh, near, -1)], 1)[at, best]
            ahead[rows] = np.concatenate([ahead[rows], fresh], 1)[at, best]
            rows = rows[ahead[rows].any(1)]
            if not len(rows):
                break
            first = np.where(ahead[rows], sims[rows], -np.inf)
            k = min(STRIDE, width)
            pick = np.argpartition(-first, k - 1, 1)[:, :k]
            at, row = np.arange(len(rows))[:, None], rows[:, None]
            follow = ahead[row, pick]
            ahead[row, pick] = False
            near = np.where(follow[:, :, None], table[ids[row, pick]], -1).reshape(len(rows), -1).astype(np.int64)
        order = np.lexsort((ids, -sims), axis=1)
        at = np.arange(n)[:, None]
        return np.where(sims > -np.inf, ids, -1)[at, order], sims[at, order]

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """For each row of q the nodes found (-1 for none)."""
        at = np.full((len(q), 1), self.entry)
        for layer in range(len(self.lists) - 1, 0, -1):
            at = self.beam(q, at, layer, ENTRIES)[0]
        return self.beam(q, at, 0, beam)[0]


INDEX = "shard string, dim int, n int, vectors binary, ids binary, `first` binary, level binary, layers int, lists binary"


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (doubles) of distinct rows whose vector can be compared."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).distinct()


def build_index(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", shard_size: int = SHARD,
    links: int = LINKS, candidates: int = CANDIDATES,
) -> DataFrame:
    """One row a shard (INDEX). Rows are dealt by a hash of the id; vectors of another length are other
    shards. Equal vectors of a shard are one node, with all their ids. Written to the shared folder."""
    require(vectors, vec_id, embedding)
    release_heaps(vectors.sparkSession)
    rows = materialise(_usable(vectors, vec_id, embedding), "vectors")
    shards = max(1, -(-rows.count() // shard_size))
    rows = rows.withColumn("shard", F.concat_ws("-", F.size("v"), F.pmod(F.xxhash64("vec_id"), F.lit(shards))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        column = table.column("v").combine_chunks()
        v = column.flatten().to_numpy().reshape(len(ids), -1)
        order = np.lexsort((ids, *v.T[::-1]))
        ids, v = ids[order], np.ascontiguousarray(v[order])
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]).any(1)))
        v = v[first]
        deal = np.random.default_rng(len(v)).permutation(len(v))  # insertion order: not the sorted one
        ends = np.append(first[1:], len(ids))
        ids = np.concatenate([ids[first[i] : ends[i]] for i in deal])
        starts = np.append(0, np.cumsum((ends - first)[deal]))
        v = np.ascontiguousarray(v[deal])
        scale = np.abs(v).max(1, keepdims=True)
        unit = v / scale
        unit = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(np.float32)
        graph = Graph.build(unit, len(v), links, candidates)
        return pa.table(
            {
                "shard": [key[0].as_py()], "dim": pa.array([v.shape[1]], pa.int32()), "n": pa.array([len(v)], pa.int32()),
                "vectors": [v.tobytes()], "ids": [ids.astype(np.int64).tobytes()], "first": [starts.astype(np.int64).tobytes()],
                "level": [graph.level.astype(np.int8).tobytes()], "layers": pa.array([len(graph.lists)], pa.int32()),
                "lists": [b"".join(x.tobytes() for x in graph.lists)],
            }
        )

    return materialise(rows.groupBy("shard").applyInArrow(run, INDEX), "index")


def by_powers(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component below one: exact, and products of
    very large or small components neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict, links: int):
        n, dim = row["n"], row["dim"]
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.vectors = by_powers(vectors)
        self.ids, self.first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)
        unit = (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)
        flat, lists, at = np.frombuffer(row["lists"], np.int32), [], 0
        for layer in range(row["layers"]):
            most = 2 * links if layer == 0 else links
            lists.append(flat[at : at + n * most].reshape(n, most))
            at += n * most
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.graph = Graph(unit, np.frombuffer(row["level"], np.int8), lists)

    def nearest(self, query_ids: list[int], queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """(query's id, id, score) of the k nearest of each query."""
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        unit = (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)
        found: list[tuple[int, int, float]] = []
        for query_id, q, row in zip(query_ids, by_powers(queries), self.graph.search(unit, beam), strict=True):
            nodes = row[row >= 0]
            scores = (self.vectors[nodes] * q).sum(1) / (self.norms[nodes] * np.sqrt((q * q).sum()))
            out: list[tuple[float, int]] = []
            for node, score in zip(nodes.tolist(), scores.tolist(), strict=True):
                # Ids of equal vectors are sorted: k + 1 of them are enough without the query's own.
                ids = self.ids[self.first[node] : min(self.first[node + 1], self.first[node] + k + 1)]
                out += [(-score, int(i)) for i in ids if i != query_id]
            found += [(query_id, i, -s) for s, i in sorted(out)[:k]]
        return found


def search(
    index: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
    beam: int = BEAM, links: int = LINKS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by cosine in double precision,
    ties to the smaller id; never the query's own id.

    Queries are sent to every shard of their length and answered there in blocks as they stream by;
    a task holds one shard and one block. Queries or vectors that are null, zero, or hold null or
    non-finite components take no part, as do null ids; equal (id, vector) rows count once; an id
    with several vectors is one neighbour, with its best. Fewer candidates than k: all found. An
    empty index or no queries: no rows.
    """
    require(queries, vec_id, embedding)
    asked = _usable(queries, vec_id, embedding).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    shards = index.select("shard", "dim")
    n = max(1, shards.count())
    sent = asked.join(F.broadcast(shards) if n <= 10_000 else shards, F.size("q") == F.col("dim")).select("shard", F.lit(1).alias("kind"), "query_id", "q")
    rows = index.withColumn("kind", F.lit(0)).unionByName(sent, allowMissingColumns=True)
    rows = rows.repartition(min(n, 10_000), "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, asked = None, None, []

        def answers() -> pa.RecordBatch:
            found = shard.nearest([i for i, _ in asked], np.array([q for _, q in asked]), k, beam) if asked and shard else []
            asked.clear()
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

        kinds = (pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield answers()
                    shard, name = Shard(row, links), row["shard"]
                elif row["shard"] == name:
                    asked.append((row["query_id"], row["q"]))
                    if len(asked) == BATCH:
                        yield answers()
        yield answers()
        release_worker()

    near = rows.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
