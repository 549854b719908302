"""Merkle manifests of tables, in DataFrame operations.

Every row is a leaf. The leaves of a group (a language) are ordered, and runs of eight consecutive nodes become the
hash of their digests, level by level, until one node of the group remains; the groups' nodes are hashed likewise up
to one root. A parent is stored as its preimage, the digests of its children one after another. A leaf's path is the
preimages of its ancestors: in each, its own slot of 64 characters is what it replaces when it is folded up to the
root, and the rest are its siblings.

Ranks come from a sort by range that is written with its places, so no window holds a group; a group of children has
eight rows at most. The paths of a level are joined to the level below, so that one join brings a leaf all of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import cut, partitions

FANOUT, DIGEST = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PLACE = (1 << 33) - 1


def field_bytes(value: Column) -> Column:
    """What a field adds to its leaf: its length in UTF-8 bytes, a colon and its value, or - for null."""
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_bytes, values)), 256)


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a written table with ``_at``, the place of each row in the order, from 0, and ``_part``, its part of the sort.

    The sort's parts may differ in size, and rows equal in ``order`` are dealt over several by their place in df, which
    is a written table itself.
    """
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (*order, "_tie")]
    # Evaluated on the sorted rows and written at once: the part of the sort and the place in it.
    laid = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    laid = cut(laid.withColumn("_id", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_id", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()  # one row for each part of the sort
    before, firsts = 0, []
    for p, n in sorted((r._part, r.n) for r in sizes):
        firsts.append((p, before))
        before += n
    first = df.sparkSession.createDataFrame(firsts, "_part long, _first long")
    at = (F.col("_first") + F.col("_id").bitwiseAND(F.lit(_PLACE))).alias("_at")
    return laid.withColumn("_part", part).join(F.broadcast(first), "_part").select(*(c for c in laid.columns if c != "_id"), "_part", at)


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents above nodes (tree, i, n, digest), lowest first, and each tree's top node (tree, digest).

    n: how many nodes the tree has on the level, ``most`` at most. Parents are (tree, i, n, preimage, digest). A tree of
    one node has no parents.
    """
    nodes = nodes.select("tree", "i", "n", "digest")
    levels, tops = [], nodes.where("n = 1")
    while most > 1:
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"i div {FANOUT}").alias("i"), "n")
        children = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda c: c["digest"])  # of one run
        parents = runs.agg(F.array_join(children, "").alias("preimage")).withColumn("digest", F.sha2("preimage", 256))
        parents = cut(parents.withColumn("n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}")))
        levels.append(parents)
        nodes = parents.select("tree", "i", "n", "digest")
        tops = tops.unionByName(nodes.where("n = 1"))
        most = -(-most // FANOUT)
    return levels, tops.select("tree", "digest")


def _with_paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """nodes (tree, i, n, ...) with their ``path`` and what else above has of the tree.

    A path is an array of (slot, preimage): each ancestor's preimage, nearest first, with the slot of the child on the
    way. above: (tree, path, ...) of what lies over a tree's top node. Children share their parent's path.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]

    def joined(children: DataFrame, parents: DataFrame | None) -> DataFrame:
        kept = [c for c in children.columns if c not in more]
        top = children.where("n = 1").join(above, "tree").select(*kept, *more, "path")
        if parents is None:
            return top
        slot = F.struct((F.col("i") % FANOUT).alias("slot"), F.col("_preimage").alias("preimage"))
        own = parents.select("tree", F.col("i").alias("_up"), F.col("preimage").alias("_preimage"), *more, "path")
        under = children.where("n > 1").withColumn("_up", F.expr(f"i div {FANOUT}")).join(own, ["tree", "_up"])
        return top.unionByName(under.select(*kept, *more, F.concat(F.array(slot), F.col("path")).alias("path")))

    parents = None
    for level in reversed(levels):
        parents = cut(joined(level.select("tree", "i", "n", "preimage"), parents))
    return joined(nodes, parents)


def siblings(path: Column) -> Column:
    """The digests beside a leaf's way up, concatenated: every preimage without the way's own slot."""
    own = lambda s: (s["slot"] * DIGEST).cast("int")
    rest = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), own(s)), F.substring(s["preimage"], own(s) + DIGEST + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(path, rest), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to: spliced into each preimage in turn, hashed, and so taken a level up."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.overlay(s["preimage"], h, (s["slot"] * DIGEST + 1).cast("int"), F.lit(DIGEST)), 256))


def manifest(docs: DataFrame, tampered: Column, changed: Column, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", value: str = "text") -> DataFrame:
    """One row per row of docs: its key, leaf, subroot, root, proof_sha256, folded_root and verified.

    Leaves of a group ascend by key, null keys first, equal keys by their leaf; groups ascend by their UTF-8 bytes,
    null first. Where ``tampered`` holds, ``value`` is ``changed`` in the leaf that is folded with the original
    siblings; folded_root is then another root and verified is false, unless the change changes nothing. Null fields
    count as null, empty ones as empty; texts are hashed whole, however long. Repeated rows are leaves of their own,
    each with its own place. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    own = [F.col(f) for f in fields]
    other = [changed if f == value else F.col(f) for f in fields]
    forged = F.when(tampered, leaf_digest(other))
    rows = _ranked(cut(docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf_digest(own).alias("digest"), forged.alias("forged"))), ["group", "key", "digest"])
    # A group is a stretch of the order, known by its ends in each part of the sort: as many rows as groups and parts.
    ends = cut(rows.groupBy("group", "_part").agg(F.min("_at").alias("first"), F.count("*").alias("n")))
    groups = _ranked(cut(ends.groupBy("group").agg(F.min("first").alias("start"), F.sum("n").alias("n"))), ["group"])
    groups = cut(groups.select(F.col("group").alias("g"), F.col("_at").alias("tree"), "start", "n"))
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    spots = cut(ends.select("group", F.col("_part").alias("q")).join(groups, F.col("g").eqNullSafe(F.col("group"))).select("g", "q", "tree", "start", "n"))
    # No spot has more rows than a part of the sort.
    rows = rows.join(spots, F.col("group").eqNullSafe(F.col("g")) & (F.col("_part") == F.col("q")))
    leaves = cut(rows.select("key", "digest", "forged", "tree", (F.col("_at") - F.col("start")).alias("i"), "n"))
    levels, subroots = _climb(leaves, most or 0)
    subroots = cut(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), "digest"))
    upper, top = _climb(subroots, count)
    top = top.first()
    over = spark.range(1).select(F.col("id").alias("tree"), F.array().cast("array<struct<slot:bigint,preimage:string>>").alias("path"))
    above = cut(_with_paths(subroots, upper, over).select(F.col("i").alias("tree"), F.col("digest").alias("subroot"), "path"))
    root, path = F.lit(top.digest if top else None).cast("string"), F.col("path")
    folded = fold(F.coalesce("forged", "digest"), path)
    out = _with_paths(leaves, levels, above).select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings(path), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
