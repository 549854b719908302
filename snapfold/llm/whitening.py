"""Whitening of embeddings by a tiled covariance.

Dimensions are cut into tiles, and each pair of tiles is a key. Blocks of rows give up their columns tile by tile;
column blocks meet again by row-block, every pair of tiles is multiplied there, products are summed per pair of tiles
(within a task first, then over tasks in two steps), and the tiles are assembled into one matrix of dimensions by
dimensions, which is all that reaches the driver, whatever the number of rows. Its eigenvectors whiten the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import cut

#: Columns of a tile; rows of a block; groups in which a tile's sums from all tasks are added up first.
TILE, BLOCK, SUMS = 32, 4096, 32
#: Fixed values of the query: components are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: A component whose variance is less than this part of the largest is rounding, not variance.
RANK = 1e-12


class Moments(NamedTuple):
    n: int
    sums: list[int] | list[float]
    covariance: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vector: Column) -> Column:
    """Whether a vector is there with finite components only, none beyond what whole numbers of the scale can hold."""
    v = vector.cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < (1 << 30) / SCALE))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``dims`` columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), dtype=flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + OFFSET


def _sums(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> tuple[int, list]:
    """Rows and sums per dimension of what ``values`` makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            X = values(batch)
            n, total = n + len(X), total + X.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "total"])

    per_task = cut(df.mapInArrow(run, f"n long, total array<{kind}>"))
    n = per_task.agg(F.sum("n")).first()[0] or 0
    sums = per_task.select(F.posexplode("total").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # one row a dimension
    return n, [r.x for r in sorted(sums, key=lambda r: r.at)]


def covariance(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], kind: str, tile: int = TILE, block: int = BLOCK) -> Moments:
    """n, sums and covariance (divisor n, centred before multiplying) of what ``values`` makes of each batch of df."""
    n, sums = _sums(df, values, kind)
    dims = len(sums)
    if not n or not dims:
        return Moments(n, sums, np.zeros((dims, dims)))
    means = np.array([s / n for s in sums])
    edges = list(range(0, dims, tile))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            X = values(batch)
            for k in range(0, len(X), block):
                Y = X[k : k + block] - means
                parts = [np.ascontiguousarray(Y[:, e : e + tile]).tobytes() for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(edges)), pa.array(range(len(edges)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "tile", "part"])
                at += 1

    def multiply(key: tuple, rows: pa.Table) -> pa.Table:
        wide = [min(tile, dims - e) for e in edges]
        parts = {t: np.frombuffer(p, dtype=np.float64).reshape(-1, wide[t]) for t, p in zip(rows["tile"].to_pylist(), rows["part"].to_pylist(), strict=True)}
        keys = [(a, b) for a in parts for b in parts if a <= b]
        return pa.table({"a": pa.array([a for a, _ in keys], pa.int32()), "b": pa.array([b for _, b in keys], pa.int32()), "product": pa.array([(parts[a].T @ parts[b]).tobytes() for a, b in keys], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, p in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                total[a, b] = total.get((a, b), 0) + np.frombuffer(p, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["a", "b", "product"])

    def one_sum(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(rows.select(["a", "b", "product"]).to_batches())))

    product = "a int, b int, product binary"
    blocks = df.mapInArrow(columns, "block long, tile int, part binary")
    # By row-block, then summed within each task: what leaves a task is one matrix, not one for each block.
    products = blocks.groupBy("block").applyInArrow(multiply, product).mapInArrow(add, product)
    some = products.groupBy("a", "b", F.pmod(F.spark_partition_id(), F.lit(SUMS)).alias("part")).applyInArrow(one_sum, product)
    tiles = cut(some.groupBy("a", "b").applyInArrow(one_sum, product)).collect()  # dims by dims numbers in all
    V = np.zeros((dims, dims))
    for r in tiles:
        i, j = edges[r.a], edges[r.b]
        T = np.frombuffer(r.product, dtype=np.float64).reshape(min(tile, dims - i), -1)
        V[i : i + T.shape[0], j : j + T.shape[1]] = T
        V[j : j + T.shape[1], i : i + T.shape[0]] = T.T
    return Moments(n, sums, V / n)


class Whitening(NamedTuple):
    moments: Moments
    values: np.ndarray  # by falling eigenvalue
    vectors: np.ndarray  # unit eigenvectors, in columns

    @property
    def matrix(self) -> np.ndarray:
        """Takes centred rows to whitened ones; NaN columns for components without variance."""
        top = self.values.max(initial=0)
        e = np.where(self.values > RANK * top, self.values, np.nan)
        return self.vectors / np.sqrt(e)

    @property
    def explained(self) -> np.ndarray:
        trace = np.trace(self.moments.covariance)
        return np.maximum(self.values, 0) / trace if trace > 0 else np.full(len(self.values), np.nan)


def fit(vectors: DataFrame, vector: str, components: int = COMPONENTS, tile: int = TILE) -> Whitening:
    """The components of largest variance of all usable vectors."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    moments = covariance(rows, lambda batch: scaled(matrix(batch.column(0), dims)), "long", tile)
    values, units = np.linalg.eigh(moments.covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(moments, values[order], units[:, order])


def deviations(X: np.ndarray, moments: Moments) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where no long can hold it."""
    off = X * moments.n - np.array(moments.sums, dtype=np.int64)
    about, exact = (off.astype(np.float64) ** 2).sum(1), (off * off).sum(1).astype(object)
    for i in np.flatnonzero(about > 0.99 * 2**63):  # the sum may have gone round
        d = sum(int(o) ** 2 for o in off[i])
        exact[i] = d if d < 1 << 63 else None
    return exact.tolist()


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A component c of a vector counts as x = floor(64 c) + 1000000. whitened is the centred x on a unit eigenvector of
    the covariance of all usable rows, over the square root of its eigenvalue; explained is that eigenvalue over the
    trace; identity_error is the largest entry of whitened's own covariance, less the identity, over all rows.

    Null vectors and vectors with null or non-finite components take no part, nor do components of 2^24 and more in
    size, whose deviation no long can hold; a deviation beyond a long is null. A shorter vector counts as zero in the
    components it lacks. Components without variance (equal rows, a single row) have a null whitened value and stay
    out of identity_error, which is null if there is no other. Ids may be null or repeat: each row counts and has its
    own results. Extra columns are ignored; no usable row, or none with a component, gives an empty result.
    """
    model = fit(vectors, vector, components, tile)
    usable_rows = vectors.where(usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    dims, W, means, moments = len(model.moments.sums), model.matrix, model.moments.means if model.moments.n else None, model.moments
    has = ~np.isnan(W).any(0)
    schema = vectors.select(F.col(vec_id).alias("vec_id")).schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if not moments.n or not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    project = lambda X: (X - means) @ W
    error = None
    if has.any():
        again = covariance(usable_rows.select("v"), lambda batch: project(scaled(matrix(batch.column(0), dims)))[:, has], "double", tile)
        error = float(np.abs(again.covariance - np.eye(len(again.sums))).max())
    k, explained = W.shape[1], model.explained
    nullable = lambda a: pa.array(a, pa.float64(), from_pandas=True)  # noqa: E731  NaN is null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X = scaled(matrix(batch.column(1), dims))
            m = len(X)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, moments.n)),
                pa.array(deviations(X, moments), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), nullable(project(X).ravel()), nullable(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return usable_rows.mapInArrow(run, schema)
