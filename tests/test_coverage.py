"""Schedules against observations, and classification that appends."""

import datetime

from snapfold.operators import coverage, reclassify

DAY = datetime.date(2024, 1, 5)


def test_games_are_covered_missing_or_extra(spark):
    schedule = spark.createDataFrame([("2023-24", "regular", DAY, "A@B"), ("2023-24", "regular", DAY, "A @ B"), ("2023-24", "regular", DAY, "C@D"), ("2023-24", "playoffs", DAY, "E@F"), ("2023-24", "playoffs", None, "G@H")], "season string, season_type string, game_date date, matchup string")
    seen = spark.createDataFrame([(DAY, "A @ B"), (DAY, "A@B"), (DAY, "X@Y"), (DAY, None)], "game_date date, matchup string")
    whole = spark.createDataFrame([(DAY, "E@F"), (DAY, "A@B")], "game_date date, matchup string")
    games = coverage.covered(schedule, seen, whole)
    got = {(r.matchup.replace(" ", ""), r.status, r.player_observed, r.all_available) for r in games.where("game_date is not null").collect()}
    assert got == {("A@B", "covered", True, True), ("C@D", "missing", False, False), ("E@F", "covered", False, True), ("X@Y", "extra", True, False)}
    by = {r.season_type: r for r in coverage.summary(games.where("game_date is not null"), ["season_type"]).collect()}
    assert (by["regular"].scheduled_games, by["regular"].missing_games, by["regular"].total_covered_pct) == (2, 1, 50.0)
    assert (by["playoffs"].player_observation_coverage_pct, by["playoffs"].total_covered_pct) == (0.0, 100.0)
    meta = coverage.schedule_meta(spark.createDataFrame([(1, DAY, "C @D"), (2, DAY, "Q@R"), (3, datetime.date(1950, 1, 1), "Q@R")], "id int, game_date date, matchup string"), schedule)
    assert {r.id: (r.season, r.season_type) for r in meta.collect()} == {1: ("2023-24", "regular"), 2: ("2023-24", "regular"), 3: (None, None)}


def test_classification_appends_what_is_new(spark, tmp_path):
    schema = "entry_id long, reason string, category string"
    first = [(1, "Injury/Illness - Left Knee; Sprain", "Injury/Illness"), (2, "Rest", None), (3, None, None)]
    folder = f"file://{tmp_path}/conditions"
    run = lambda rows: reclassify.classify_unprocessed(spark.createDataFrame(rows, schema), folder, 7)
    assert run(first) == 3 and run(first) == 0
    assert run([*first, (4, "Injury/Illness - Left Knee; Sprain, Right Ankle; Soreness", "Injury/Illness"), (4, "twice", None), (None, "x", None)]) == 1
    rows = spark.read.parquet(folder).collect()
    assert sorted((r.entry_id, r.condition_index) for r in rows if r.entry_id < 4) == [(1, 1), (2, 1), (3, 1)]
    assert {r.classification_version for r in rows} == {7} and {r.is_injury for r in rows if r.entry_id in (2, 3)} == {False}
    assert run([]) == 0
