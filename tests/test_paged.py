"""Chains of pages as batch and as stream."""

import json

import pytest

from snapfold.sources import paged

SCHEMA = "id long, name string"


def write(folder, part, name, rows, follows):
    (folder / part).mkdir(parents=True, exist_ok=True)
    (folder / part / name).write_text(json.dumps({"rows": rows, "next": follows}))


def read(spark, folder, **options):
    spark.dataSource.register(paged.Paged)
    return sorted(map(tuple, spark.read.format("paged").options(**options).schema(SCHEMA).load(f"file://{folder}").collect()))


def test_chains_are_followed_to_their_end(spark, tmp_path):
    assert read(spark, tmp_path / "nothing") == []
    write(tmp_path, "a", "0.json", [{"id": 1, "name": "x", "more": 5}, {"id": 2}], "z.json")
    write(tmp_path, "a", "z.json", [], "k.json")
    write(tmp_path, "a", "k.json", [{"id": 3, "name": "y"}], None)
    write(tmp_path, "b", "0.json", [{"id": 4, "name": "w"}], None)
    write(tmp_path, "b", "stray.json", [{"id": 9}], None)  # no page names it
    assert read(spark, tmp_path) == [(1, "x"), (2, None), (3, "y"), (4, "w")]


def test_loops_and_endless_chains_are_errors(spark, tmp_path):
    write(tmp_path, "a", "0.json", [{"id": 1}], "1.json")
    write(tmp_path, "a", "1.json", [{"id": 2}], "0.json")
    with pytest.raises(Exception, match="comes after itself"):
        read(spark, tmp_path)
    write(tmp_path, "a", "1.json", [{"id": 2}], "2.json")
    write(tmp_path, "a", "2.json", [{"id": 3}], None)
    with pytest.raises(Exception, match="more than 2 pages"):
        read(spark, tmp_path, most=2)
    assert len(read(spark, tmp_path, most=3)) == 3


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    spark.dataSource.register(paged.Paged)
    source = tmp_path / "in"
    write(source, "a", "0.json", [{"id": 1}], "1.json")  # the next page is not there yet
    for step in range(3):
        if step == 1:
            write(source, "a", "1.json", [{"id": 2}], None)
            write(source, "b", "0.json", [{"id": 3}], None)
        stream = spark.readStream.format("paged").schema(SCHEMA).load(f"file://{source}")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()) == [1] if step == 0 else [1, 2, 3]
