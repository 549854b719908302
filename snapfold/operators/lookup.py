"""Lookups: prioritised ranges, gap filling, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.functions import rules

PRIORITY = ("playoffs", "play_in", "regular", "preseason")


def phases(table: str = rules.PHASES) -> list[tuple[str, str, str, str]]:
    rows = [tuple(line.split()) for line in table.strip().splitlines()]
    return sorted(rows, key=lambda r: (r[0], PRIORITY.index(r[1])))


def season_phase(day: Column, table: str = rules.PHASES) -> Column:
    """struct(season, phase) of a day, first hit by season and priority; null outside. The table is a constant of some 30 rows."""
    d = day.cast("date")
    hits = [F.when(d.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.struct(F.lit(s).alias("season"), F.lit(p).alias("phase"))) for s, p, a, b in phases(table)]
    return F.coalesce(*hits)


def phase_sql(table: str = rules.PHASES) -> str:
    """The phases as rows of a VALUES list."""
    return ", ".join(f"('{s}', '{p}', DATE '{a}', DATE '{b}', {i})" for i, (s, p, a, b) in enumerate(phases(table)))


def missing_days(spark: SparkSession, df: DataFrame, group: str, day: str) -> DataFrame:
    """Days between a group's first and last that it has no row for."""
    d = F.col(day).cast("date")
    every = df.groupBy(group).agg(F.min(d).alias("a"), F.max(d).alias("b")).select(group, F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(df.select(group, d.alias("day")).distinct(), [group, "day"], "left_anti")


def digest(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """SHA-256 over a group's rows in order; fields apart by a unit separator, nulls as <null>."""
    line = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns))
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*group).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("digest"), F.count("*").alias("n"))
