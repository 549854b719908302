"""Tables that change together: cascades, versions, broken-off and concurrent changes."""

import pytest
from pyspark.sql import functions as F

from snapfold.operators import versioned
from snapfold.operators.versioned import Link, Unused


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def tables(spark, tmp_path):
    t = versioned.Tables(spark, f"file://{tmp_path}/set", buckets=4)
    reports = spark.createDataFrame([(i,) for i in range(20)], "report long")
    entries = spark.createDataFrame([(i, i % 20, i % 7) for i in range(100)] + [(999, None, 6)], "entry long, report long, team long")
    conditions = spark.createDataFrame([(i, i % 100, i % 11) for i in range(300)], "condition long, entry long, episode long")
    notes = spark.createDataFrame([("a", 3, 5), ("b", 4, 250), ("c", 19, 299), ("d", None, None)], "note string, report long, condition long")
    teams = spark.createDataFrame([(i,) for i in range(9)], "team long")
    t.put({"reports": (reports, "report"), "entries": (entries, "entry"), "conditions": (conditions, "condition"), "notes": (notes, "note"), "teams": (teams, "team")})
    return t


LINKS = (Link("conditions", "entry", "entries", "entry"), Link("entries", "report", "reports", "report"), Link("notes", "report", "reports", "report"), Link("notes", "condition", "conditions", "condition"))
IDLE = (Unused("teams", "team", (("entries", "team"),)),)


def test_deletes_follow_links_of_any_depth_and_over_several_ways(spark, tables):
    gone = {3, 10, 17}
    lost = tables.delete("reports", spark.createDataFrame([(i,) for i in [*gone, 3, 777]] + [(None,)], "x long"), LINKS, IDLE)
    entries = [(i, i % 20, i % 7) for i in range(100) if i % 20 not in gone] + [(999, None, 6)]
    kept = {e[0] for e in entries}
    assert rows(tables.read("reports")) == sorted([(i,) for i in range(20) if i not in gone], key=repr)
    assert rows(tables.read("entries")) == sorted(entries, key=repr)
    conditions = [(i, i % 100, i % 11) for i in range(300) if i % 100 in kept]
    assert rows(tables.read("conditions")) == sorted(conditions, key=repr)
    assert rows(tables.read("notes").select("note")) == [("c",), ("d",)] if 250 % 100 not in kept else [("b",), ("c",), ("d",)]
    assert rows(tables.read("teams")) == [(i,) for i in range(7)]
    assert lost == {"reports": 3, "entries": 15, "conditions": 45, "notes": 4 - tables.read("notes").count(), "teams": 2}
    assert tables.version() == 2 and tables.read("reports", version=1).count() == 20  # the old version is still there
    assert tables.delete("reports", spark.createDataFrame([(3,)], "x long"), LINKS, IDLE) == {k: 0 for k in ("reports", "entries", "conditions", "notes", "teams")}
    assert tables.version() == 2  # nothing to do, no version


def test_only_touched_buckets_are_written(spark, tables):
    before = tables.manifest()
    tables.delete("reports", spark.createDataFrame([(3,)], "x long"), LINKS[:2])
    after = tables.manifest()
    assert after["teams"] == before["teams"] and after["notes"] == before["notes"]
    same = [b for b in before["reports"]["folders"] if before["reports"]["folders"][b] == after["reports"]["folders"].get(b)]
    assert len(same) == len(before["reports"]["folders"]) - 1


def test_a_broken_off_change_leaves_the_old_version(spark, tables, monkeypatch):
    monkeypatch.setattr(versioned.Tables, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.delete("reports", spark.createDataFrame([(3,)], "x long"), LINKS, IDLE)
    assert tables.version() == 1 and tables.read("reports").count() == 20 and tables.read("conditions").count() == 300


def test_of_two_changes_at_once_one_wins(spark, tables):
    version, manifest = tables.version(), tables.manifest()
    tables.delete("reports", spark.createDataFrame([(3,)], "x long"))
    with pytest.raises(versioned.Conflict):
        tables._commit(manifest, version + 1)
    assert tables.version() == 2 and tables.read("reports").count() == 19


def test_circles_are_refused_and_empty_tables_are_fine(spark, tmp_path):
    with pytest.raises(ValueError):
        versioned.order_of("a", (Link("b", "x", "a", "x"), Link("a", "x", "b", "x")))
    t = versioned.Tables(spark, f"file://{tmp_path}/empty")
    assert t.version() == 0
    t.put({"a": (spark.range(0).withColumn("v", F.lit(1)), "id"), "b": (spark.range(3), "id")})
    assert t.read("a").count() == 0 and t.delete("b", spark.range(5), (Link("a", "id", "b", "id"),)) == {"b": 3, "a": 0}
    assert t.read("b").count() == 0 and t.read("b").columns == ["id"]


def test_a_large_bucket_is_dealt_out_over_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        df = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
        tables = versioned.Tables(spark, str(tmp_path / "large"), buckets=2)
        tables.put({"t": (df, "k")})
        folders = tables.manifest()["t"]["folders"]
        assert sorted(folders) == ["0", "1"] and min(len(list((tmp_path / "large" / f).glob("part-*"))) for f in folders.values()) > 4
        assert tables.read("t").exceptAll(df).isEmpty() and tables.read("t").count() == 200_000
    finally:
        spark.conf.set(size, before)
