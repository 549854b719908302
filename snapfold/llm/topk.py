"""Exact top-k inner products by the threshold algorithm.

Each shard holds one list per dimension, sorted by component, made once. A query walks all lists at once, from the end that its
own component's sign favours, scores every vector it meets by random access, and stops when the bound, the inner
product with the components at the walk's depth, cannot beat its k-th best score. Shards' results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import cut, heavy_groups, padded

SHARD, QUERY_BLOCK = 8192, 2048
SCALE = 256


SHARD_SCHEMA = "shard int, n long, ids binary, vectors binary, lists binary"


def build_lists(shard: int, ids: np.ndarray, X: np.ndarray) -> pd.DataFrame:
    """A shard as one row: its vectors by id, and for each dimension the rows in ascending order of their component."""
    order = np.argsort(ids, kind="stable")
    X = np.ascontiguousarray(X[order], dtype=float)
    lists = np.argsort(X, axis=0, kind="stable").astype(np.int32)
    return pd.DataFrame([{"shard": shard, "n": len(ids), "ids": ids[order].astype(np.int64).tobytes(), "vectors": X.tobytes(), "lists": lists.tobytes()}])


def threshold_search(built: pd.Series, query_ids: np.ndarray, Q: np.ndarray, k: int) -> pd.DataFrame:
    """Exact top k of a built shard by (score, then smaller id). Components are integers as doubles (exact below 2^53)."""
    n = int(built["n"])
    ids, X = np.frombuffer(built["ids"], dtype=np.int64), np.frombuffer(built["vectors"], dtype=float).reshape(n, -1)
    up = np.frombuffer(built["lists"], dtype=np.int32).reshape(n, -1)
    values = np.take_along_axis(X, up, axis=0)
    out = []
    for qid, q in zip(query_ids.tolist(), Q, strict=True):
        active = np.flatnonzero(q != 0)
        falls = q[active] > 0  # these lists are walked from their high end
        seen = np.zeros(n, dtype=bool)
        best_score, best_row = np.empty(0), np.empty(0, dtype=np.int64)
        depth, step = 0, max(32, n // 64)
        if not len(active):  # every score is 0: the smaller ids
            depth = n
            best_row = np.arange(min(n, k + 1))
            best_score = np.zeros(len(best_row))
            best_row, best_score = (x[ids[best_row] != qid][:k] for x in (best_row, best_score))
        while depth < n:
            to = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            high, low = active[falls], active[~falls]
            if len(high):
                met[up[n - to : n - depth, high].ravel()] = True
            if len(low):
                met[up[depth:to, low].ravel()] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            rows_ = rows[ids[rows] != qid]
            score = np.concatenate([best_score, X[rows_] @ q])
            row = np.concatenate([best_row, rows_])
            first = np.lexsort((row, -score))[:k] if len(score) <= 4 * k else None
            if first is None:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                some = np.flatnonzero(score >= edge)
                first = some[np.lexsort((row[some], -score[some]))[:k]]
            best_score, best_row = score[first], row[first]
            depth, step = to, step * 2
            at_depth = np.where(falls, values[n - depth, active], values[depth - 1, active])
            bound = float(q[active] @ at_depth)
            # An unseen vector that only ties the k-th may have the smaller id: stop when none can even tie.
            if len(best_score) == k and best_score[-1] > bound or seen.all():
                break
        out += [(qid, int(ids[r]), int(s)) for s, r in zip(best_score, best_row, strict=True)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x), ties to the smaller id, self left out.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; zero vectors do. A
    vector with fewer components than another counts as 0 in the others, so an empty one scores 0. Rows that repeat an
    id count once (the vector least in order). Scores are exact while they fit 2^53. Extra columns are ignored; an
    empty table gives an empty result.
    """

    def pick(df):
        v = F.col(vector).cast("array<double>")
        fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        whole = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
        return df.where(fine & F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("long").alias("id")).agg(F.min(whole).alias("v"))

    base, asked = cut(pick(vectors)), cut(pick(queries))
    n, dims = base.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked, dims_asked = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, shards, blocks = max(dims or 0, dims_asked or 0), max(1, math.ceil(n / shard)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    base, asked = (padded(df, "v", dims) for df in (base, asked))
    dealt = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return build_lists(int(key[0]), own["id"].to_numpy(), np.stack(own["v"].to_list()))

    built = cut(heavy_groups(dealt, shards, "shard").applyInPandas(build, SHARD_SCHEMA))
    copies = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def run(lists: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if not len(lists) or not len(far):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return threshold_search(lists.iloc[0], far["id"].to_numpy(), np.stack(far["v"].to_list()), k)

    groups = [heavy_groups(df, shards * blocks, "shard", "block") for df in (copies, every)]
    found = groups[0].cogroup(groups[1]).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
