"""Digests of large groups as trees of hashes over ranges of a key, and where two tables differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.tables import cut

#: Keys of a range, and ranges of the next one.
FAN = 1024


def line(columns: list[str]) -> Column:
    """A row as text: fields apart by a unit separator, nulls as <null>."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns))


def _range(key: str, width: int) -> Column:
    return F.floor(F.col(key) / F.lit(width)).cast("long")


def ranges(df: DataFrame, group: list[str], key: str, columns: list[str], fan: int = FAN) -> DataFrame:
    """(group, node, digest, n): the digest of the rows of each range of ``fan`` integer keys, in order of key and row.

    A range is hashed in one task; its rows are as many as keys, unless keys repeat. Rows without a key are a range of
    their own.
    """
    row = F.struct(F.col(key).alias("key"), line(columns).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"])
    return df.groupBy(*group, _range(key, fan).alias("node")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count("*").alias("n"))


def tree_digest(df: DataFrame, group: list[str], key: str, columns: list[str], fan: int = FAN) -> DataFrame:
    """(group, digest, n) of each group: digests of ranges are hashed in order of the ranges, ``fan`` at a time, up to one.

    The result does not depend on partitions. No task holds more than ``fan`` digests or the rows of one range, however
    large a group is. All groups have as many levels as the widest table needs.
    """
    nodes = cut(ranges(df, group, key, columns, fan))
    while True:
        low, high = nodes.agg(F.min("node"), F.max("node")).first()
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        up = nodes.groupBy(*group, _range("node", fan).alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), "\n"), 256).alias("digest"), F.sum("n").alias("n"))
        nodes = cut(up.withColumnRenamed("up", "node"))
        if low is None or high // fan - low // fan <= 1:  # ranges on both sides of zero never become one
            break
    # What is left of a group is two nodes at most, and one for rows without a key.
    rest = F.array_sort(F.collect_list(F.struct(F.col("node").isNotNull().alias("known"), F.coalesce("node", F.lit(0)).alias("node"), "digest")))
    one = F.when(F.size(rest) > 1, F.sha2(F.array_join(F.transform(rest, lambda r: r["digest"]), "\n"), 256)).otherwise(rest[0]["digest"])
    return nodes.groupBy(*group).agg(one.alias("digest"), F.sum("n").alias("n"))


def flat_digest(df: DataFrame, group: list[str], key: str, columns: list[str], fan: int = FAN) -> DataFrame:
    """(group, digest, n) of each group: the digests of its ranges hashed in one go, in order of the ranges.

    The task that hashes a group holds 64 characters for ``fan`` keys, and no rows. Rows without a key come last.
    """
    nodes = F.array_sort(F.collect_list(F.struct(F.col("node").isNull().alias("lost"), "node", "digest")))
    one = F.sha2(F.array_join(F.transform(nodes, lambda r: r["digest"]), "\n"), 256)
    return ranges(df, group, key, columns, fan).groupBy(*group).agg(one.alias("digest"), F.sum("n").alias("n"))


def differences(a: DataFrame, b: DataFrame, group: list[str], key: str, columns: list[str], fan: int = FAN) -> DataFrame:
    """(group, key, side, row) of rows that only one of two tables has, each as often as it has more of it.

    Digests of ranges are compared first, so only rows of ranges that differ are compared themselves.
    """
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "node")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    left, right = ranges(a, group, key, columns, fan).alias("a"), ranges(b, group, key, columns, fan).alias("b")
    both = left.join(right, on, "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    odd = cut(both.select(*(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(f"_{c}") for c in (*group, "node"))))
    inside = F.lit(True)
    for c in (*group, "node"):
        inside = inside & F.col(c).eqNullSafe(F.col(f"_{c}"))

    def rows(df: DataFrame, weight: int) -> DataFrame:
        named = df.select(*group, F.col(key).alias("key"), _range(key, fan).alias("node"), line(columns).alias("row"), F.lit(weight).alias("weight"))
        return named.join(odd, inside, "left_semi")

    net = rows(a, 1).unionByName(rows(b, -1)).groupBy(*group, "key", "row").agg(F.sum("weight").alias("net")).where("net <> 0")
    return net.select(*group, "key", F.when(F.col("net") > 0, "left").otherwise("right").alias("side"), "row", F.abs("net").alias("times"))
