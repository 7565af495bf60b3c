"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node that carries its ``k + 1`` smallest ids, all that a
result of k neighbours can hold, as ties go to the smaller id. Nodes are dealt
to shards of about ``SHARD_NODES`` by hash. Each shard's graph is stored as a
row of flat arrays: the neighbours of node i on level 0 are entries i * 2M to
(i + 1) * 2M, with -1 for none, and so on upwards with M each for the nodes of
that level. Every query visits every shard; the shards' results are merged by
distance.

Graphs are built and searched over vectors less the shard's mean and divided by
the largest component, in double precision and by differences, so neither a far
origin nor a large scale blurs the distances.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, park, ship

SHARD_NODES, QUERY_BLOCK = 4096, 1024
M, EF_BUILD, EF_SEARCH = 12, 40, 128


class Graph:
    def __init__(self, vectors: np.ndarray, m: int = M):
        self.m, self.n = m, len(vectors)
        self.scale = float(np.abs(vectors).max(initial=0.0)) or 1.0
        x = vectors / self.scale
        self.mean = x.mean(axis=0) if len(x) else x.sum(axis=0)
        self.x = np.ascontiguousarray(x - self.mean)
        self.levels = np.zeros(self.n, dtype=np.int32)
        self.links: list[np.ndarray] = []  # of each level, a row for each node
        self.entry = 0

    def build(self, ef: int = EF_BUILD, seed: int = 0) -> Graph:
        rng = np.random.default_rng(seed)
        self.levels = np.minimum(-np.log(1 - rng.random(self.n)) / math.log(self.m), 12).astype(np.int32)
        self.links = [np.full((self.n, self.m * (2 if level == 0 else 1)), -1, dtype=np.int32) for level in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = 0
        for i in range(1, self.n):
            self._insert(i, ef)
        return self

    def _distances(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        away = self.x[nodes] - q
        return np.einsum("ij,ij->i", away, away).tolist()

    def _layer(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on a level, nearest first, by squared distance."""
        links, seen = self.links[level], bytearray(self.n)
        for _, s in starts:
            seen[s] = 1
        near, found = list(starts), [(-d, s) for d, s in starts]
        heapq.heapify(near)
        heapq.heapify(found)
        worst = -found[0][0]
        while near:
            d, node = heapq.heappop(near)
            if d > worst and len(found) >= ef:
                break
            fresh = [v for v in links[node].tolist() if v >= 0 and not seen[v]]
            if not fresh:
                continue
            for v, dv in zip(fresh, self._distances(q, fresh)):
                seen[v] = 1
                if len(found) < ef:
                    heapq.heappush(found, (-dv, v))
                elif dv < worst:
                    heapq.heapreplace(found, (-dv, v))
                else:
                    continue
                heapq.heappush(near, (dv, v))
                worst = -found[0][0]
        return sorted((-d, v) for d, v in found)

    def _select(self, candidates: list[tuple[float, int]], count: int, own: np.ndarray) -> list[int]:
        """Candidates nearer to the node than to any chosen one; free places go to the nearest left."""
        nodes = [v for _, v in candidates]
        if len(nodes) <= count:
            return nodes
        x = self.x[nodes] - own
        to_node = np.einsum("ij,ij->i", x, x)
        between = to_node[:, None] + to_node[None] - 2 * (x @ x.T)
        chosen: list[int] = []
        blocked = np.zeros(len(nodes), dtype=bool)
        for k in range(len(nodes)):
            if not blocked[k]:
                chosen.append(k)
                if len(chosen) == count:
                    break
                blocked |= between[k] < to_node
        rest = [k for k in range(len(nodes)) if k not in set(chosen)]
        return [nodes[k] for k in chosen + rest[: count - len(chosen)]]

    def _insert(self, i: int, ef: int) -> None:
        q, level, top = self.x[i], int(self.levels[i]), int(self.levels[self.entry])
        at = [(self._distances(q, [self.entry])[0], self.entry)]
        for layer in range(top, level, -1):
            at = self._layer(q, at[:1], 1, layer)
        for layer in range(min(top, level), -1, -1):
            at = self._layer(q, at, ef, layer)
            links = self.links[layer]
            chosen = self._select(at, self.m, q)
            links[i, : len(chosen)] = chosen
            for v in chosen:
                row = links[v]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                    continue
                others = [*row.tolist(), i]
                ranked = sorted(zip(self._distances(self.x[v], others), others))
                kept = self._select(ranked, len(row), self.x[v])
                row[: len(kept)] = kept
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        q = q / self.scale - self.mean
        at = [(self._distances(q, [self.entry])[0], self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = self._layer(q, at[:1], 1, layer)
        return [v for _, v in self._layer(q, at, max(ef, 1), 0)]

    def flat(self) -> bytes:
        """Neighbours of all levels, one level after the other; upper levels hold only their own nodes."""
        parts = [links[self.levels >= level] for level, links in enumerate(self.links)]
        return np.concatenate([p.ravel() for p in parts]).astype("<i4").tobytes()

    @classmethod
    def load(cls, vectors: np.ndarray, levels: np.ndarray, entry: int, flat: bytes, m: int = M) -> Graph:
        g = cls(vectors, m)
        g.levels, g.entry = levels, entry
        values, at = np.frombuffer(flat, dtype="<i4"), 0
        for level in range(int(levels.max(initial=0)) + 1):
            own, width = np.flatnonzero(levels >= level), m * (2 if level == 0 else 1)
            links = np.full((g.n, width), -1, dtype=np.int32)
            links[own] = values[at : at + len(own) * width].reshape(len(own), width)
            at += len(own) * width
            g.links.append(links)
        return g


def euclidean(away: np.ndarray) -> np.ndarray:
    """Lengths of the rows; where a square leaves the range of doubles, by way of the largest component."""
    with np.errstate(over="ignore"):
        out = np.sqrt((away**2).sum(axis=1))
    top = np.abs(away).max(axis=1, initial=0.0)
    odd = (top > 0) & (~np.isfinite(out) | (out < 1e-150))
    out[odd] = top[odd] * np.sqrt(((away[odd] / top[odd, None]) ** 2).sum(axis=1))
    return out


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int = 10, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """vectors (vec_id, vector as array<double>): one row of flat arrays for each shard (dim, shard)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    nodes = park(few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "hnsw-nodes")
    shards = max(1, math.ceil(nodes.count() / shard_nodes))
    dealt = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    ship(vectors.sparkSession)

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda r: ids[r][0])  # the same graph on every run
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        x = np.asarray(group.column("vector").combine_chunks().flatten(), dtype="<f8").reshape(-1, dim)[order]
        ids = [ids[r] for r in order]
        g = Graph(x).build(seed=shard)
        row = {
            "dim": dim, "shard": shard, "entry": g.entry, "vectors": x.tobytes(), "levels": g.levels.astype("<i4").tobytes(), "links": g.flat(),
            "ids": np.array([v for r in ids for v in r], dtype="<i8").tobytes(), "counts": np.array([len(r) for r in ids], dtype="<i4").tobytes(),
        }
        return pa.table({c: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for c, v in row.items()})

    schema = "dim int, shard int, entry int, vectors binary, levels binary, links binary, ids binary, counts binary"
    return park(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, schema), "hnsw-index")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among vectors (both vec_id, vector).

    score is the Euclidean distance in double precision. Rows that share an id
    count as the query's own; of several queries of one id the smallest vector
    is asked. Unusable queries give no row; vectors of another length than the
    query's are not compared.
    """
    index = build_index(vectors, k, shard_nodes)
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    places = index.select("dim", "shard").groupBy("dim").agg(F.collect_list("shard").alias("shards")).withColumnRenamed("dim", "d")
    visits = asked.join(places, F.size("vector") == F.col("d")).select(F.col("d").alias("dim"), F.explode("shards").alias("shard"), "vec_id", "vector")
    blocks = visits.groupBy("dim", "shard", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, asked.count() // QUERY_BLOCK))).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "vector")).alias("queries")
    )
    pairs = index.join(blocks, ["dim", "shard"]).select(*index.columns, "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                x = np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, row["dim"])
                g = Graph.load(x, np.frombuffer(row["levels"], dtype="<i4"), row["entry"], row["links"])
                counts = np.frombuffer(row["counts"], dtype="<i4")
                ids, after = np.frombuffer(row["ids"], dtype="<i8"), np.cumsum(counts)
                out = []
                for q in row["queries"]:
                    own, v = q["vec_id"], np.array(q["vector"], dtype=np.float64)
                    hits = g.search(v, ef)
                    away = euclidean(x[hits] - v).tolist()
                    named = [(d, int(i)) for d, h in zip(away, hits) for i in ids[after[h] - counts[h] : after[h]] if i != own]
                    out += [(own, i, d) for d, i in heapq.nsmallest(k, named)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "vec_id", "score"])

    hits = arrow_map(pairs, search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
