"""States of acquired documents, and recomputation of rows whose version is not the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state(http_status: Column, is_document: Column, parse_error: Column, parsed: Column) -> Column:
    """State of a candidate from what is known of it; failures are rows, never exceptions.

    No answer yet: discovered. 404: missing. Other answers but 200: http_failed. No document: invalid_document. Then
    parse_failed, parsed, or downloaded while no parse was tried.
    """
    return (
        F.when(http_status.isNull(), "discovered")
        .when(http_status == 404, "missing")
        .when(http_status != 200, "http_failed")
        .when(~F.coalesce(is_document, F.lit(False)), "invalid_document")
        .when(parse_error.isNotNull(), "parse_failed")
        .when(F.coalesce(parsed, F.lit(False)), "parsed")
        .otherwise("downloaded")
    )


def pending(candidates: DataFrame, column: str = "state", retry: bool = False) -> DataFrame:
    """What a run takes up: new and downloaded candidates, failed ones if they are tried again."""
    return candidates.where(F.col(column).isin("discovered", "downloaded", *(("http_failed", "parse_failed") if retry else ())))


def recompute(rows: DataFrame, version: str, current: int, compute: dict[str, Column], downstream: DataFrame | None = None) -> DataFrame:
    """Rows with ``compute`` applied where their version is not the current one; ``updated`` marks those.

    Refused while something downstream was built from them. A second run updates nothing.
    """
    if downstream is not None and not downstream.isEmpty():
        raise ValueError("rows that others were built from must not change")
    stale = ~F.col(version).eqNullSafe(current)
    changed = {c: F.when(F.col("updated"), v).otherwise(F.col(c)) for c, v in compute.items()}
    return rows.withColumn("updated", stale).withColumns(changed).withColumn(version, F.lit(current))
