"""Keep-one operators: best score, latest snapshot, last source wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in an order that should be total. Null keys form a group."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row per key, ties to the least ``tie``. An aggregate: partial results combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.unix_micros(F.col(at).cast("timestamp"))).alias("a"), F.col(tie).alias("b")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], column: str, out: str) -> DataFrame:
    """The last non-null value of a column up to each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def episodes_by_gap(df: DataFrame, keys: list[str], at: str, tie: str, days: int) -> DataFrame:
    """Number the runs of each key in which no two neighbours lie more than ``days`` apart."""
    w = W.partitionBy(*keys).orderBy(at, tie)
    gap = F.datediff(F.col(at), F.lag(at).over(w))
    return df.withColumn("_new", (gap.isNull() | (gap > days)).cast("int")).withColumn("episode", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def status_changes(df: DataFrame, keys: list[str], order: list[Column], status: str) -> DataFrame:
    """Changes of a status per key, equal neighbours collapsed."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = (F.row_number().over(w) > 1) & ~F.lag(status).over(w).eqNullSafe(F.col(status))
    return df.withColumn("_changed", changed).groupBy(*keys).agg(F.count_if("_changed").alias("changes"), F.count("*").alias("n"))
