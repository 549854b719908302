"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt into shards of bounded size. In each shard a graph is built by insertion: a greedy beam search from
the shard's medoid proposes neighbours, and relaxed distance pruning keeps those that no nearer neighbour covers.
Queries are beam-searched in every shard, and the shards' results merged by exact distance.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import cut, heavy_groups, padded

#: Vectors a shard holds about, out-degree at which pruning stops (edges back may double it), beam of the build, beam of the search, relaxation of the pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 8192, 32, 48, 160, 1.2
#: Queries that one task takes to a shard at once.
QUERY_BLOCK = 2048


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, finite throughout and not zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


class Graph:
    """Directed graph over the rows of X."""

    def __init__(self, X: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        self.X, self.norm, self.degree, self.alpha = X, (X * X).sum(1), degree, alpha
        n = len(X)
        self.next = [np.empty(0, dtype=np.int64)] * n
        self.start = int(((X - X.mean(0)) ** 2).sum(1).argmin()) if n else 0
        order = np.random.default_rng(5).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]) if n else order
        for i in order[1:].tolist():
            seen, far = self.search(X[i], beam, visited=True)
            self.next[i] = self._prune(i, seen, far)
            for j in self.next[i].tolist():
                back = np.append(self.next[j], i)
                if len(back) > 2 * degree:  # room for as many again: pruning at every new edge would cost most of the build
                    back = self._prune(j, back, self._far(X[j], back))
                self.next[j] = back

    @classmethod
    def of(cls, X: np.ndarray, next_: list[np.ndarray], start: int) -> Graph:
        """A graph that was built before."""
        graph = cls.__new__(cls)
        graph.X, graph.norm, graph.next, graph.start = X, (X * X).sum(1), next_, start
        return graph

    def _far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.norm[rows] - 2 * (self.X[rows] @ q)  # squared distance less |q|^2

    def search(self, q: np.ndarray, beam: int, visited: bool = False):
        """Rows near q with their distances (squared, less |q|^2), nearest first: of the beam, or all that were expanded."""
        seen = np.zeros(len(self.X), dtype=bool)
        seen[self.start] = True
        first = float(self._far(q, np.array([self.start]))[0])
        todo, best, expanded = [(first, self.start)], [(-first, -self.start)], []
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            expanded.append((d, i))
            rows = self.next[i]
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            seen[rows] = True
            far = self._far(q, rows)
            if len(best) >= beam:
                ok = far < -best[0][0]
                rows, far = rows[ok], far[ok]
            for f, j in zip(far.tolist(), rows.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (-f, -j))
                elif f < -best[0][0]:
                    heapq.heapreplace(best, (-f, -j))
                else:
                    continue
                heapq.heappush(todo, (f, j))
        found = sorted(expanded) if visited else sorted((-f, -j) for f, j in best)
        return np.array([j for _, j in found], dtype=np.int64), np.array([f for f, _ in found])

    def _prune(self, i: int, rows: np.ndarray, far: np.ndarray) -> np.ndarray:
        rows, at = np.unique(rows[rows != i] if (rows == i).any() else rows, return_index=True)
        far = self._far(self.X[i], rows) + self.norm[i]
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], np.maximum(far[order], 0)
        kept = []
        alive = np.ones(len(rows), dtype=bool)
        V, N = self.X[rows], self.norm[rows]
        a2 = self.alpha**2
        for k in range(len(rows)):
            if not alive[k]:
                continue
            kept.append(k)
            if len(kept) == self.degree:
                break
            between = N + N[k] - 2 * (V @ V[k])
            alive &= a2 * between > far
        return rows[kept]


SHARD_SCHEMA = "shard int, ids binary, bounds binary, nodes binary, degrees binary, edges binary, start long"


def build_shard(shard: int, ids: np.ndarray, X: np.ndarray) -> pd.DataFrame:
    """A shard's graph as one row. Equal vectors are one node with all their ids, ascending."""
    order = np.argsort(ids, kind="stable")
    ids, X = ids[order], X[order]
    nodes, node_of = np.unique(X, axis=0, return_inverse=True)
    node_of = node_of.ravel()
    by_node = np.argsort(node_of, kind="stable")
    bounds = np.searchsorted(node_of[by_node], np.arange(len(nodes) + 1))
    graph = Graph(nodes)
    arrays = {"ids": ids[by_node], "bounds": bounds, "nodes": nodes, "degrees": np.array([len(r) for r in graph.next]), "edges": np.concatenate(graph.next)}
    return pd.DataFrame([{"shard": shard, **{k: v.tobytes() for k, v in arrays.items()}, "start": graph.start}])


def search_shard(built: pd.Series, query_ids: np.ndarray, Q: np.ndarray, k: int, beam: int) -> pd.DataFrame:
    """The k nearest of a built shard for each query.

    Only a node's k + 1 least ids can be among k results that tie towards smaller ids (the query itself may be one).
    """
    ids, bounds, degrees, edges = (np.frombuffer(built[c], dtype=np.int64) for c in ("ids", "bounds", "degrees", "edges"))
    nodes = np.frombuffer(built["nodes"], dtype=float).reshape(len(degrees), -1)
    graph = Graph.of(nodes, np.split(edges, np.cumsum(degrees)[:-1]), int(built["start"]))
    out = []
    for qid, q in zip(query_ids.tolist(), Q, strict=True):
        rows, _ = graph.search(q, max(beam, 2 * k))
        exact = np.sqrt(((nodes[rows] - q) ** 2).sum(1))
        best = np.argsort(exact, kind="stable")[: k + 1]
        found = sorted((float(exact[b]), int(i)) for b in best for i in ids[bounds[rows[b]] : bounds[rows[b] + 1]][: k + 1])
        out += [(qid, i, d) for d, i in found if i != qid][:k]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, ties to the smaller id, self left out.

    Vectors that are null, zero, or hold null or non-finite components take no part, on either side; neither do null
    ids. With at most k other vectors all are returned. Rows that repeat an id count once (the vector least in order).
    A vector with fewer components than another counts as 0 in the others. Extra columns are ignored; an empty table gives an empty result.
    """
    pick = lambda df: usable(df, vector).where(F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    base, asked = cut(pick(vectors)), cut(pick(queries))
    n, dims = base.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked, dims_asked = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, shards, blocks = max(dims or 0, dims_asked or 0), max(1, math.ceil(n / shard)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    base, asked = (padded(df, "v", dims) for df in (base, asked))
    dealt = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return build_shard(int(key[0]), own["id"].to_numpy(), np.stack(own["v"].to_list()))

    # Each graph is built once, however many blocks of queries there are.
    built = cut(heavy_groups(dealt, shards, "shard").applyInPandas(build, SHARD_SCHEMA))
    copies = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def run(graph: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(far):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_shard(graph.iloc[0], far["id"].to_numpy(), np.stack(far["v"].to_list()), k, beam)

    groups = [heavy_groups(df, shards * blocks, "shard", "block") for df in (copies, every)]
    found = groups[0].cogroup(groups[1]).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
