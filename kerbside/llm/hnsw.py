"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard's graph is built in one
task, on one node per distinct vector, and kept as one row of flat neighbour arrays. Queries visit every shard; the shards' results are
merged by distance. A task reads a shard's index once and its queries as a stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import mix64
from kerbside.llm.vectors import matrix, usable
from kerbside.session import cut_lineage

SHARD_ROWS = 4096
LINKS = 16  # per node above the ground level, twice as many on it
CANDIDATES = 64  # considered for the links of a new node
BREADTH = 128  # of a search on the ground level
SLICE = 5000  # queries a task searches a shard for


def _spread_out(order: np.ndarray, dist: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """The candidates, nearest first, that are nearer to the node than to any candidate chosen before."""
    chosen: list[int] = []
    for c in order:
        if not chosen or (among[c, chosen] >= dist[c]).all():
            chosen.append(int(c))
            if len(chosen) == most:
                break
    return chosen


def build_level(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array (rows of ``most``, -1 for none) of nodes inserted in order, nearest first."""
    n = len(x)
    square = (x * x).sum(1)
    dist = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
    links: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        near = np.argpartition(dist[i, :i], CANDIDATES - 1)[:CANDIDATES] if i > CANDIDATES else np.arange(i)
        near = near[np.lexsort((near, dist[i, near]))]
        picked = _spread_out(np.arange(len(near)), dist[i, near], dist[np.ix_(near, near)], most // 2)
        links[i] = [int(near[p]) for p in picked]
        for j in links[i]:
            links[j].append(i)
            if len(links[j]) > most:
                have = np.array(links[j])
                have = have[np.lexsort((have, dist[j, have]))]
                kept = _spread_out(np.arange(len(have)), dist[j, have], dist[np.ix_(have, have)], most)
                links[j] = [int(have[p]) for p in kept]
    out = np.full((n, most), -1, np.int32)
    for i, some in enumerate(links):
        out[i, :len(some)] = some
    return out


def _folded(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order by distinct vector, where each vector's ids start, distinct vectors)."""
    number: dict[bytes, int] = {}
    x = x + 0.0  # no negative zeros
    own = np.array([number.setdefault(v.tobytes(), len(number)) for v in x])
    order = np.lexsort((ids, own))
    first = np.flatnonzero(np.diff(own[order], prepend=-1))
    return ids[order], np.append(first, len(ids)), x[order[first]]


class Graph:
    """A shard's graph of distinct vectors: ids of each, vectors and, per level, its nodes and their neighbours."""

    def __init__(self, ids, first, x, nodes, links):
        self.ids, self.first, self.x, self.nodes, self.links = ids, first, x, nodes, links
        self.rows = [{int(v): r for r, v in enumerate(some)} for some in nodes[1:]]

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> "Graph":
        ids, first, x = _folded(ids, x)
        chance = mix64(ids[first[:-1]].view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        order = np.argsort(chance, kind="stable")
        sizes = np.diff(first)[order]
        ids = np.concatenate([ids[first[v]:first[v + 1]] for v in order])
        first, x, chance = np.concatenate(([0], np.cumsum(sizes))), x[order], chance[order]
        level = (-np.log((mix64(chance) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54) / np.log(LINKS)).astype(int)
        nodes, links = [], []
        for at in range(level.max() + 1):
            some = np.flatnonzero(level >= at).astype(np.int32)
            near = build_level(x[some], 2 * LINKS if at == 0 else LINKS)
            nodes.append(some)
            links.append(np.where(near >= 0, some[near], -1).astype(np.int32))
        return cls(ids, first, x, nodes, links)

    def _distance(self, q: np.ndarray, at) -> np.ndarray:
        return ((self.x[at] - q) ** 2).sum(axis=-1)

    def _only(self, own: int) -> np.ndarray:
        """Which nodes hold no other id."""
        is_own = self.ids == own
        if not is_own.any():
            return np.zeros(len(self.x), bool)
        return np.add.reduceat(~is_own, self.first[:-1], dtype=np.int64) == 0

    def search(self, q: np.ndarray, k: int, breadth: int, own: int | None = None) -> list[tuple[float, int]]:
        """The (squared distance, id) of the k nearest found, nearest first, without the id ``own``: the
        search passes through its vectors, but they take no place among what is found."""
        hidden = np.zeros(len(self.x), bool) if own is None else self._only(own)
        here = int(self.nodes[-1][0])
        best = float(self._distance(q, here))
        for level in range(len(self.nodes) - 1, 0, -1):
            while True:
                near = self.links[level][self.rows[level - 1][here]]
                near = near[near >= 0]
                if not len(near):
                    break
                dist = self._distance(q, near)
                at = int(dist.argmin())
                if dist[at] >= best:
                    break
                here, best = int(near[at]), float(dist[at])
        seen = np.zeros(len(self.x), bool)
        seen[here] = True
        todo, found = [(best, here)], [] if hidden[here] else [(-best, here)]
        ground = self.links[0]
        while todo:
            dist, at = heapq.heappop(todo)
            if len(found) >= breadth and dist > -found[0][0]:
                break
            near = ground[at]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for d, v in zip(self._distance(q, near).tolist(), near.tolist()):
                if len(found) < breadth or d < -found[0][0]:
                    heapq.heappush(todo, (d, v))
                    if not hidden[v]:
                        (heapq.heappush if len(found) < breadth else heapq.heapreplace)(found, (-d, v))
        hits: list[tuple[float, int]] = []
        edge = float("inf")  # as far as the k-th hit
        for d, v in sorted((-d, v) for d, v in found):
            if d > edge:
                break
            ids = self.ids[self.first[v]:self.first[v + 1]]
            hits += [(d, i) for i in ids[ids != own][:k].tolist()]
            edge = d if len(hits) >= k else edge
        return sorted(hits)[:k]


INDEX = "dim int, shard int, ids binary, first binary, vectors binary, nodes array<binary>, links array<binary>"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of every usable vector: one row per shard, flat arrays of little-endian numbers.

    Equal vectors of a shard are one node of its graph, which holds all their ids.
    """
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("dim", F.size("vector"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("_shards"))
    rows = rows.join(F.broadcast(sizes), "dim").withColumn(  # one row per vector length
        "shard", F.pmod(F.xxhash64("vec_id"), F.col("_shards")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = Graph.build(rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_list()).astype(np.float64))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [g.ids.tobytes()],
                             "first": [g.first.astype(np.int64).tobytes()], "vectors": [g.x.tobytes()],
                             "nodes": [[n.tobytes() for n in g.nodes]], "links": [[n.tobytes() for n in g.links]]})

    return cut_lineage(rows.select("dim", "shard", "vec_id", "vector").groupBy("dim", "shard").applyInPandas(build, INDEX))


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           breadth: int = BREADTH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all shards, without the query's own id.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Queries that
    are unusable, or of a length the index doesn't hold, have no rows.
    """
    asked = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = cut_lineage(asked.withColumn("dim", F.size("vector")))
    sizes = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    asked = asked.join(F.broadcast(sizes), "dim").withColumn(
        "slice", F.pmod(F.xxhash64("query_id"), F.col("_slices")).cast("int"))
    # every query goes to every shard of its length: a stated query set against all rows, in blocks
    visits = asked.join(index.select("dim", "shard"), "dim").select("dim", "shard", "slice", "query_id", "vector")
    empty = {c: F.lit(None).cast(t) for c, t in (x.rsplit(" ", 1) for x in INDEX.split(", ")) if c not in ("dim", "shard")}
    visits = visits.withColumns(empty)
    graphs = index.join(F.broadcast(sizes), "dim").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices").withColumns(
        {"query_id": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>")})
    rows = graphs.unionByName(visits).select("dim", "shard", "slice", "query_id", "vector", "ids", "first", "vectors", "nodes", "links")
    rows = rows.repartition("dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", F.asc_nulls_first("query_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            out: list[tuple] = []
            query_ids = batch.column(3).to_pylist()
            for at, query_id in enumerate(query_ids):
                if query_id is None:
                    ids, first, raw, nodes, links = (batch.column(c)[at].as_py() for c in (5, 6, 7, 8, 9))
                    ids, first = np.frombuffer(ids, np.int64), np.frombuffer(first, np.int64)
                    nodes = [np.frombuffer(n, np.int32) for n in nodes]
                    graph = Graph(ids, first, np.frombuffer(raw, np.float64).reshape(len(first) - 1, -1), nodes,
                                  [np.frombuffer(m, np.int32).reshape(len(n), -1) for n, m in zip(nodes, links)])
                    continue
                q = matrix(batch.column(4).slice(at, 1))[0]
                out += [(query_id, v, float(np.sqrt(d))) for d, v in graph.search(q, k, max(breadth, k), query_id)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.float64())], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all rows for the rows that ``is_query`` marks; see ``build_index``, ``search``.

    Null and zero vectors and those with null or non-finite components take no part, as query or as
    candidate. An empty table gives an empty result; with fewer than k candidates all are returned.
    Rows that repeat an id are candidates each, but never for the query of that id.
    """
    index = build_index(vectors, id_col, vector_col)
    return search(index, vectors.where(is_query), k, id_col, vector_col)
