"""The made-up reasons and notes of the classifying queries reach the rules, and SQL agrees with the columns."""

import duckdb
import pytest

from snapfold.functions import rules
from snapfold.functions import text as X
from snapfold.plans import catalogue, rule_sql


@pytest.fixture(scope="module")
def drawn():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT range AS event_id FROM range({rule_sql.DRAWN})")
    return con


def labels(*tables):
    return {label for table in tables for label, _ in rules.lines(table)}


def test_every_place_and_state_is_drawn(drawn):
    rows = drawn.sql(rule_sql.reasons_sql()).fetchall()
    assert labels(rules.ANATOMY) <= {r[1] for r in rows}
    assert labels(rules.CONDITION_FIRST, rules.CONDITION_THEN) | {"recovery", "surgery"} <= {r[3] for r in rows}
    assert {r[2] for r in rows} == {None, "left", "right", "bilateral"} and {r[4] for r in rows} == {True, False}


def test_every_noted_place_is_drawn(drawn):
    rows = drawn.sql(rule_sql.notes_sql()).fetchall()
    assert labels(rules.NOTE_PARTS) <= {r[1] for r in rows}
    assert labels(rules.NOTE_CONDITIONS) <= {r[2] for r in rows}


@pytest.mark.parametrize("name", ["classify_reasons", "classify_notes"])
def test_sql_agrees_on_all_drawn_texts(spark, drawn, tmp_path, name):
    spark.range(rule_sql.DRAWN).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    found = getattr(catalogue, name)(spark, str(tmp_path))
    wanted = drawn.sql({"classify_reasons": rule_sql.reasons_sql, "classify_notes": rule_sql.notes_sql}[name]()).fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_known_reasons(spark):
    """Cases by hand, apart from the tables' order."""
    cases = {
        "Injury/Illness - Left Knee; ACL Tear": ("knee", "left", "ACL tear", True), "Injury/Illness - Right Ankle; Sprain": ("ankle", "right", "sprain", True), "Rest": (None, None, None, False),
        "G League - Two-Way": (None, None, None, False), "Injury/Illness - N/A; Illness": ("illness", None, "illness", True), "Injury/Illness - Lumbar; Soreness": ("back", None, "soreness", True),
        "Bilateral Hip; Strain": ("hip", "bilateral", "strain", True), "Coach's Decision": (None, None, None, False),
    }
    rows = spark.createDataFrame([(r,) for r in cases], "reason string").select("reason", X.classify(X.F.col("reason")).alias("c")).select("reason", "c.*").collect()
    assert {r.reason: (r.body_part, r.laterality, r.injury_type, r.is_injury) for r in rows} == cases
