"""Which rows enter: admission of transactions, substantive entries, checked rules and publication windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions import dates
from snapfold.functions import text as X


def admitted(df: DataFrame, relinquished: str, acquired: str) -> DataFrame:
    """Rows that name someone relinquished; those with an acquisition alone go. Adds ``who``, without a bullet."""
    return df.where(F.col(relinquished).isNotNull()).withColumn("who", X.strip_bullet(F.col(relinquished)))


def substantive(df: DataFrame, entry_type: str, status: str, player: str = "player") -> DataFrame:
    """Entries of a player with a status that is not blank."""
    return df.where((F.col(entry_type) == player) & F.col(status).isNotNull() & (F.trim(status) != ""))


def checked(df: DataFrame, rules: Mapping[str, Column], failed: str = "failed") -> DataFrame:
    """Add the names of the rules that a row breaks, in order, joined by ';' ('' if none). A null test is no breach, as in a CHECK."""
    return df.withColumn(failed, F.concat_ws(";", *(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())))


def published(df: DataFrame, day: str, first: str, restored: tuple[str, str, str] | None = None, first_month: int = 10) -> DataFrame:
    """Rows from ``first`` on, and those in the restored window (first day, last day, season) that belong to its season."""
    d = F.col(day).cast("date")
    keep = d >= F.lit(first).cast("date")
    if restored:
        low, high, season = restored
        keep = keep | (d.between(F.lit(low).cast("date"), F.lit(high).cast("date")) & (dates.season(d, first_month) == season))
    return df.where(keep)


def low_flags(df: DataFrame, *counts: str, share: float = 0.3) -> DataFrame:
    """Add low_<count> for each count: whether it is under ``share`` of the upper median of all rows. Null counts are 0.

    df has a row for each period: the medians are one row.
    """
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    medians = [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY coalesce(`{c}`, 0) DESC)").alias(f"_{c}") for c in counts]
    flags = {f"low_{c}": (F.col(f"_{c}") > 0) & (of(c) < F.col(f"_{c}") * share) for c in counts}
    return df.join(F.broadcast(df.agg(*medians))).withColumns(flags).drop(*(f"_{c}" for c in counts))


def flag_verdict(games: DataFrame, by: list[str], kind: str, flag: str) -> DataFrame:
    """Whether a flag of another schedule tells the kinds of a season's games: one row per ``by``, from one grouped pass.

    flag is null where the other schedule lacks the game. It tells the kinds if only playoffs are flagged, play-in games
    are flagged alike, and no preseason or play-in game is lacking; playoffs without the flag are counted only.
    """
    flagged, plain, lacking = F.col(flag), ~F.col(flag), F.col(flag).isNull()
    of = lambda name, holds: F.count_if((F.col(kind) == name) & holds)
    counts = games.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(flagged & (F.col(kind) != "playoffs"), F.col(kind)))), ";").alias("flagged_kinds"),
        of("playoffs", plain).alias("plain_playoffs"),
        of("play_in", flagged).alias("flagged_play_in"),
        of("play_in", plain).alias("plain_play_in"),
        of("preseason", lacking).alias("lacking_preseason"),
        of("play_in", lacking).alias("lacking_play_in"),
    )
    mixed = (F.col("flagged_play_in") > 0) & (F.col("plain_play_in") > 0)
    return counts.withColumn("reproducible", (F.col("flagged_kinds") == "") & ~mixed & (F.col("lacking_preseason") + F.col("lacking_play_in") == 0))
