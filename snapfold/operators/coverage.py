"""A schedule against what was observed: covered, missing and extra games; and the schedule's word on an entry's season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.operators import lookup


def matchup_key(matchup: Column) -> Column:
    """A matchup without its spaces."""
    return F.replace(matchup, F.lit(" "), F.lit(""))


def _games(df: DataFrame, name: str) -> DataFrame:
    return df.select("game_date", matchup_key(F.col("matchup")).alias("game")).dropna().distinct().withColumn(name, F.lit(True))


def covered(schedule: DataFrame, observed: DataFrame, all_available: DataFrame) -> DataFrame:
    """All games of a schedule (season, season_type, game_date, matchup, ...) and all others that were seen.

    Adds scheduled, player_observed (a player's entry), all_available (a team with all its players) and status: covered,
    missing (scheduled only) or extra (seen only, without a season). Matchups are compared without spaces; a game that
    is scheduled or seen several times is one.
    """
    rest = [c for c in schedule.columns if c not in ("game_date", "matchup")]
    first = F.min(F.struct("matchup", *rest)).alias("_x")
    planned = schedule.withColumn("game", matchup_key(F.col("matchup"))).groupBy("game_date", "game").agg(first).select("game_date", "game", "_x.*").withColumn("scheduled", F.lit(True))
    seen = _games(observed, "player_observed").join(_games(all_available, "all_available"), ["game_date", "game"], "full_outer")
    both = planned.join(seen, ["game_date", "game"], "full_outer").na.fill(False, ["scheduled", "player_observed", "all_available"])
    any_seen = F.col("player_observed") | F.col("all_available")
    status = F.when(~F.col("scheduled"), "extra").when(any_seen, "covered").otherwise("missing")
    return both.withColumn("matchup", F.coalesce("matchup", "game")).withColumn("status", status).drop("game")


def summary(games: DataFrame, by: list[str]) -> DataFrame:
    """Scheduled, observed, available and missing games and their percentages for each of ``by``."""
    count = lambda holds: F.count_if(F.col("scheduled") & holds)
    percent = lambda part: F.coalesce(F.round(F.try_divide(F.col(part) * 100.0, F.col("scheduled_games")), 1), F.lit(0.0))
    counts = games.where("scheduled").groupBy(*by).agg(
        count(F.lit(True)).alias("scheduled_games"), count(F.col("player_observed")).alias("games_with_player_observations"), count(F.col("all_available")).alias("games_with_all_available"),
        count(F.col("status") == "covered").alias("covered_games"), count(F.col("status") == "missing").alias("missing_games"),
    )
    return counts.withColumns({"player_observation_coverage_pct": percent("games_with_player_observations"), "total_covered_pct": percent("covered_games")})


def schedule_meta(entries: DataFrame, schedule: DataFrame) -> DataFrame:
    """entries (game_date, matchup, ...) with season and season_type: those of the scheduled game of that day and matchup,
    else of the period that the day lies in; null where it lies in none."""
    plan = schedule.groupBy(F.col("game_date").alias("_day"), matchup_key(F.col("matchup")).alias("_game")).agg(F.min(F.struct("season", F.col("season_type").alias("phase"))).alias("_planned"))
    joined = entries.join(plan, (F.col("game_date") == F.col("_day")) & (matchup_key(F.col("matchup")) == F.col("_game")), "left")
    found = F.coalesce("_planned", lookup.season_phase(F.col("game_date")))
    return joined.withColumns({"season": found["season"], "season_type": found["phase"]}).drop("_day", "_game", "_planned")
