"""Classification of what has none yet, appended to what has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.functions import text as X
from snapfold.tables import cut, stored

SCHEMA = "entry_id long, condition_index int, body_part string, laterality string, injury_type string, normalized_reason string, is_injury boolean, classification_version int"


def classify_unprocessed(entries: DataFrame, folder: str, version: int, entry_id: str = "entry_id", reason: str = "reason", category: str = "category") -> int:
    """Classify the entries that have no condition in ``folder`` yet and append theirs; returns how many entries that were.

    Each distinct reason is classified once. Spark commits an append as a whole, so a run that breaks off is simply run
    again, and a run with nothing new writes nothing. Entries without an id are left out.
    """
    done = stored(entries.sparkSession, folder, SCHEMA).select(F.col("entry_id").alias(entry_id)).distinct()
    todo = cut(entries.select(F.col(entry_id).cast("long").alias(entry_id), reason, category).dropna(subset=[entry_id]).dropDuplicates([entry_id]).join(done, entry_id, "left_anti"))
    n = todo.count()
    if n:
        found = X.conditions_of(todo, reason, category, "_found").select(F.col(reason).alias("_reason"), F.col(category).alias("_category"), "_found")
        joined = todo.join(found, F.col(reason).eqNullSafe(F.col("_reason")) & F.col(category).eqNullSafe(F.col("_category")))
        each = joined.select(F.col(entry_id).alias("entry_id"), F.posexplode("_found").alias("at", "c"))
        names = ("body_part", "laterality", "injury_type", "normalized_reason", "is_injury")
        each.select("entry_id", (F.col("at") + 1).alias("condition_index"), *(f"c.{c}" for c in names), F.lit(version).alias("classification_version")).write.mode("append").parquet(folder)
    return n
