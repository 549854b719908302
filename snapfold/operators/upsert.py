"""Idempotent keyed writes and supersession, as rewrites of a table's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """existing and the incoming rows of new keys, one each: the first by ``order``."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))
    return existing.unionByName(first.join(existing, keys, "left_anti").select(existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """State after an upsert, with ``action``: inserted, updated (some value differs), skipped, or kept (not in incoming).

    Columns in ``keep`` hold their first value on update. Keys must be unique on both sides.
    """
    rest = [c for c in existing.columns if c not in keys]
    old, new = existing.withColumn("_old", F.lit(True)).alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, keys, "full_outer")
    same = F.lit(True)
    for c in rest:
        if c not in keep:
            same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(same, "skipped").otherwise("updated")
    values = [F.when(F.col("_new").isNull() | (F.lit(c in keep) & F.col("_old").isNotNull()), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in rest]
    return both.select(*keys, *values, action.alias("action"))


def supersede(existing: DataFrame, incoming: DataFrame, subject: list[str], row: list[str], at: str) -> DataFrame:
    """State after a newer publication: per subject, the rows of the latest ``at`` win over those of older ones.

    Incoming rows older than what is stored for their subject are late and ignored; at the same time they are upserted
    by ``row``. Running it again changes nothing.
    """
    stored = existing.groupBy(*subject).agg(F.max(at).alias("_stored"))
    fresh = incoming.groupBy(*subject).agg(F.max(at).alias("_fresh"))
    top = stored.join(fresh, subject, "full_outer").select(*subject, F.greatest("_stored", "_fresh").alias("_top"))
    everything = existing.withColumn("_rank", F.lit(1)).unionByName(incoming.withColumn("_rank", F.lit(0)))
    current = everything.join(top, subject).where(F.col(at) == F.col("_top"))
    rest = [c for c in existing.columns if c not in row]
    best = current.groupBy(*row).agg(F.min_by(F.struct(*rest), F.col("_rank")).alias("_x"))
    return best.select(*row, *(F.col(f"_x.{c}").alias(c) for c in rest)).select(existing.columns)


def get_or_create(dimension: DataFrame, facts: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """dimension and one row for each key that it lacks, under the name first seen."""
    first = facts.groupBy(key).agg(F.min_by(name, order).alias(name))
    return dimension.select(key, name).unionByName(first.join(dimension, key, "left_anti").select(key, name))
