"""The store of contents by hash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from snapfold.sources.blobs import BlobStore


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_each_content_is_stored_once(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/store")
    assert store.manifest().count() == 0 and store.get(frame(spark, []).select("text")).count() == 0
    assert store.put(frame(spark, ["a", "b", "a", None, "", "é" * 100_000]), "text") == 4
    assert store.put(frame(spark, ["a", "b", "", None]), "text") == 0
    assert store.put(frame(spark, ["b", "c"]), "text") == 1
    assert sorted((r.hash, r.bytes) for r in store.manifest().collect()) == sorted((hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for t in ("a", "b", "", "c", "é" * 100_000))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = spark.createDataFrame([(sha("a"),), (sha("c"),), (sha("c"),), (sha("not there"),), (None,)], "hash string")
    got = store.get(wanted)
    assert sorted((r.hash, bytes(r.content)) for r in got.collect()) == sorted([(sha("a"), b"a"), (sha("c"), b"c")])
    assert "PartitionFilters: [isnotnull(prefix" in got._jdf.queryExecution().toString() or "PartitionFilters: [prefix" in got._jdf.queryExecution().toString()


def test_batches_that_broke_off_are_not_read_and_damage_is_seen(spark, tmp_path, monkeypatch):
    store = BlobStore(spark, f"file://{tmp_path}/store")
    stray = spark.createDataFrame([("00", bytearray(b"stray"), "00")], "hash string, content binary, prefix string")
    stray.write.partitionBy("prefix").parquet(f"{store.folder}/blobs/stray")
    assert store.put(frame(spark, ["x"]), "text") == 1 and store.manifest().count() == 1
    wrong = spark.createDataFrame([("00" * 32, bytearray(b"other"), "00")], "hash string, content binary, prefix string")
    wrong.write.partitionBy("prefix").parquet(f"{store.folder}/blobs/wrong")
    spark.createDataFrame([("00" * 32, 5, "wrong")], "hash string, bytes long, batch string").write.mode("append").parquet(f"{store.folder}/manifest")
    with pytest.raises(Exception, match="damaged content"):
        store.get(spark.createDataFrame([("00" * 32,)], "hash string")).select(F.length("content")).collect()
