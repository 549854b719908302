"""Digests of ranges, trees of them and differences."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from snapfold.operators import digests
from snapfold.queries import ORACLE_SQL, QUERIES


def sha(parts):
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def plain(rows, fan):
    """Digest of one group's (key, value) rows."""
    line = lambda r: "\x1f".join("<null>" if x is None else str(x) for x in r)
    nodes = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], line(r))):
        nodes.setdefault(r[0] // fan, []).append(line(r))
    nodes = {k: sha(v) for k, v in nodes.items()}
    while True:
        done, up = max(nodes) // fan - min(nodes) // fan <= 1, {}
        for k in sorted(nodes):
            up.setdefault(k // fan, []).append(nodes[k])
        nodes = {k: sha(v) for k, v in up.items()}
        if done:
            rest = [nodes[k] for k in sorted(nodes)]
            return sha(rest) if len(rest) > 1 else rest[0]


def test_tree_digest_of_any_partitions(spark):
    rows = [(k * 37 % 900 - 50, None if k % 11 == 0 else k % 5) for k in range(1500)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, k long, v long")
    got = {digests.tree_digest(df.repartition(p), ["g"], "k", ["k", "v"], fan=4).first().digest for p in (1, 7)}
    assert got == {plain(rows, 4)}
    assert digests.tree_digest(df.limit(0), ["g"], "k", ["k", "v"]).count() == 0
    with_null = df.unionByName(spark.createDataFrame([("g", None, 1)], df.schema))
    assert digests.tree_digest(with_null, ["g"], "k", ["k", "v"], fan=4).first().digest not in got


def test_differences_are_found_with_their_number(spark):
    a = spark.createDataFrame([("g", 1, "x"), ("g", 1, "x"), ("g", 5000, "y"), (None, 3, "z"), ("g", None, "n")], "g string, k long, v string")
    b = spark.createDataFrame([("g", 1, "x"), ("g", 5000, "y"), (None, 3, "w"), ("g", None, "n")], a.schema)
    got = {(r.g, r.key, r.side, r.times) for r in digests.differences(a, b, ["g"], "k", ["v"]).collect()}
    assert got == {("g", 1, "left", 1), (None, 3, "left", 1), (None, 3, "right", 1)}
    assert digests.differences(a, a.withColumn("v", F.col("v")), ["g"], "k", ["v"]).count() == 0


def test_flat_digest_has_two_levels_for_any_number_of_ranges(spark):
    keys = [k * 37 % 900 for k in range(900)]
    df = spark.createDataFrame([("g", k, k % 5) for k in keys], "g string, k long, v long")
    nodes = [sha([f"{k}\x1f{k % 5}" for k in range(4 * i, 4 * i + 4)]) for i in range(225)]
    got = {digests.flat_digest(df.repartition(p), ["g"], "k", ["k", "v"], fan=4).first() for p in (1, 7)}
    assert got == {("g", sha(nodes), 900)}


def test_content_digest_tree_beyond_1024_ranges(spark, tmp_path):
    step = 1024 * 1200  # keys of more ranges than one node of a tree takes
    spark.range(0, step, step // 50).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), (F.col("id") % 7).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert [tuple(r) for r in QUERIES["content_digest_tree"](spark, str(tmp_path)).collect()] == db.execute(ORACLE_SQL["content_digest_tree"]).fetchall()
