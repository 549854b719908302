"""Interval candidates of two streams: rows of one key at most some days apart, joined as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates_stream(left: DataFrame, right: DataFrame, key: str, day: str, left_id: str, right_id: str, days: int = 7, late: str = "0 seconds") -> DataFrame:
    """(key, left_id, left_day, right_id, right_day) of the pairs of two streams, as ``matching.candidates`` gives of two tables.

    Each side's watermark follows its days, ``late`` behind. A row waits for partners until the other side is ``days``
    days past it, so state holds that many days of both. Rows behind the watermark are dropped (``late_rows`` counts
    them); a null key or day has no partner.
    """
    at = lambda name: F.col(day).cast("date").cast("timestamp").alias(name)
    a = left.select(F.col(key).alias(key), F.col(left_id).alias("left_id"), at("left_at")).withWatermark("left_at", late)
    b = right.select(F.col(key).alias("_key"), F.col(right_id).alias("right_id"), at("right_at")).withWatermark("right_at", late)
    apart = F.expr(f"right_at BETWEEN left_at - INTERVAL {days} DAYS AND left_at + INTERVAL {days} DAYS")
    return a.join(b, (F.col(key) == F.col("_key")) & apart).select(key, F.col("left_id").alias(left_id), F.col("left_at").cast("date").alias("left_day"), F.col("right_id").alias(right_id), F.col("right_at").cast("date").alias("right_day"))


def run(pairs: DataFrame, table: str, checkpoint: str):
    """Append the pairs of all that has arrived to a table, each once, however often the query is started again."""
    return pairs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()


def late_rows(query) -> int:
    """Rows that came after the watermark had passed them, in this run of the query."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
