"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts makes, per document, the size and a 128-bit fingerprint of its set of word shingles, band
   keys of its minima, and a signature of their low bits. Documents with equal sets are one class from here on.
2. Each class is compared with the first class of its band buckets: collision-corrected similarity from bit counts,
   then the exact test on full sets. Connected components follow.
3. Buckets that still hold several components are compared inside, in blocks of bounded size: bit counts first, then
   exact sets for the few that remain, so no link between candidates is lost and no group's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.llm.common import WORD, columns_of, cut, fresh, heavy_groups, partitions, spread

SHINGLE, SLOTS, BANDS, ROWS, BITS = 5, 128, 25, 5, 2
#: Pairs of similarity 0.8 miss all bands with probability 5e-5, those of 0.85 with 4e-7; pairs of 0.3 share one with 0.06.
#: A pair whose estimate lies this far under the threshold (4.5 standard errors of 128 two-bit slots) is no candidate.
MARGIN = 0.165
BLOCK = 256

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct k-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(k, len(words))
    places = np.arange(1, width + 1, dtype=np.uint64)
    mix = _stir(places * _MIX[(places - np.uint64(1)) % np.uint64(len(_MIX))] + np.uint64(width)) | np.uint64(1)
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = _stir(out + hashes[i : i + n] * mix[i])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, SLOTS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, SLOTS, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set, 32 bits each."""
    least = np.full(SLOTS, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(shingles), 512):
        block = shingles[i : i + 512, None] * a
        block += b
        block >>= np.uint64(32)
        np.minimum(least, block.min(0).astype(np.uint32), out=least)
    return least


SKETCH = ["n_shingles", "fp", "sig", "bands"]


def sketch(texts) -> dict[str, list]:
    """Per text: n_shingles, fp (16 bytes of its set), sig (packed low bits) and bands (keys)."""
    a, b = _permutations()
    salt = _stir(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0])
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]
    rows = []
    known: dict[bytes, tuple] = {}
    for text in texts:
        shingles = shingle_set(text)
        fp = xxhash.xxh3_128_digest(shingles.tobytes())
        if fp not in known:
            if len(shingles):
                least = minima(shingles, a, b)
                low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
                sig = np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)
                bands = salt.copy()
                for r in range(ROWS):
                    bands = _stir(bands + least[: BANDS * ROWS].reshape(BANDS, ROWS)[:, r].astype(np.uint64) * _MIX[r])
                known[fp] = (sig, bands.view(np.int64))
            else:
                known[fp] = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        rows.append((len(shingles), fp, *known[fp]))
    return dict(zip(SKETCH, map(list, zip(*rows, strict=True)) if rows else ([], [], [], []), strict=True))


def _estimate(equal_bits_of: list[tuple[Column, Column]]) -> Column:
    """Collision-corrected similarity of two signatures, from the count of slots whose bits all agree."""
    odd = F.lit(0x5555555555555555).cast("long")
    differ = sum((F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(odd)) for x, y in equal_bits_of), F.lit(0))
    return ((1 - differ / F.lit(float(SLOTS))) - F.lit(1 / 2**BITS)) / F.lit(1 - 1 / 2**BITS)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for all rows of left against all of right (arrays of packed longs)."""
    differ = np.zeros((len(left), len(right)), dtype=np.int32)
    for i in range(left.shape[1]):
        x = left[:, None, i] ^ right[None, :, i]
        differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return ((1 - differ / SLOTS) - 1 / 2**BITS) / (1 - 1 / 2**BITS)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the smallest node of each connected component.

    Each round hooks every node to its least neighbour, follows those hooks to their ends by doubling, and carries the
    edges over to the ends; edges inside a component go. Rounds grow with the logarithm of the input.
    """
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    nodes, names = edges.select(F.col("a").alias("node")).distinct(), []
    while edges.limit(1).count():
        hooks = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        while True:  # many nodes may hook to one, and one may have many edges: all joins deal frequent keys out
            end = hooks.select(F.col("a").alias("to"), F.col("to").alias("end"))
            longer = cut(spread(hooks, "to")(end).select("a", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            hooks = longer.select("a", "to")
            if not longer.where("moved").limit(1).count():
                break
        names.append(hooks)
        moved = cut(spread(edges, "a")(hooks).select(F.col("to").alias("a"), "b"))
        moved = spread(moved, "b")(hooks.select(F.col("a").alias("b"), F.col("to").alias("end")))
        edges = cut(moved.select("a", F.col("end").alias("b")).where("a != b").distinct())
    out = nodes.withColumn("label", F.col("node"))
    for hooks in names:
        out = relabelled(cut(out), hooks.select(F.col("a").alias("label"), "to"), "to").select("node", "label")
    return out


def relabelled(rows: DataFrame, names: DataFrame, to: str) -> DataFrame:
    """rows with their label replaced by that of names (label, to), where it has one. Many rows may share a label."""
    return spread(rows, "label")(names, "left").withColumn("label", F.coalesce(to, "label")).drop(to)


def text_key(text: Column) -> Column:
    """Tells apart rows of one id with different texts."""
    return F.xxhash64(F.lit(7), text)


def _sets(docs: DataFrame, need: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(fp, shingles) of the classes whose fp is in need, from one row each. need grows with the input, so it is never broadcast."""
    one = classes.join(need.select("fp").distinct(), "fp", "left_semi").select(F.col("rep").alias("_id"), F.col("key").alias("_key"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                found = [shingle_set(t) for t in batch.text[i : i + 200]]
                yield pd.DataFrame({"fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "shingles": [s.view(np.int64) for s in found]})

    return rows.mapInPandas(run, "fp binary, shingles array<long>").dropDuplicates(["fp"])


_BLOCK_KEYS = ["pack", "i", "j"]


def _blocks(members: DataFrame) -> DataFrame:
    """Members (.., bucket, fp, label, top, major, members) dealt into groups (pack, i, j) of bounded size to compare.

    Buckets of at most BLOCK members are packed together. In a larger one the ``major`` members carry the bucket's most
    frequent label, ``top``, and need no comparison among themselves: their blocks (i < 0) meet those of the others,
    whose blocks (i >= 0) meet each other as well. So rows grow by the number of blocks of the others, not of the whole
    bucket.
    """
    small = members.where(F.col("members") <= BLOCK)
    packs = max(1, small.count() // BLOCK)
    zero = F.lit(0)
    small = small.withColumns({"own": zero, "pack": F.pmod(F.xxhash64("bucket"), F.lit(packs)), "i": zero, "j": zero})
    is_major = F.col("label") == F.col("top")
    wide = lambda n: F.greatest(F.ceil(n / BLOCK).cast("int"), F.lit(1))
    n_major, n_minor = wide(F.col("major")), wide(F.col("members") - F.col("major"))
    at = F.pmod(F.xxhash64("fp"), F.when(is_major, n_major).otherwise(n_minor)).cast("int")
    with_minor = F.transform(F.sequence(zero, n_minor - 1), lambda k: F.struct((-1 - at).alias("i"), k.cast("int").alias("j")))
    with_major = F.transform(F.sequence(zero, n_major - 1), lambda k: F.struct((-1 - k).cast("int").alias("i"), at.alias("j")))
    among = F.transform(F.sequence(zero, n_minor - 1), lambda k: F.struct(F.least(at, k).cast("int").alias("i"), F.greatest(at, k).cast("int").alias("j")))
    met = F.when(is_major, with_minor).otherwise(F.concat(with_major, among))
    large = members.where(F.col("members") > BLOCK).withColumns({"own": F.when(is_major, F.lit(-1)).otherwise(at), "pack": F.col("bucket"), "met": F.explode(met)})
    large = large.withColumns({"i": F.col("met.i"), "j": F.col("met.j")}).drop("met")
    return small.unionByName(large).drop("top", "major", "members")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lowered. A null text, or one without words, has an empty
    set, no links and is kept. Texts are linked by their sets, whatever their ids: different texts under one doc_id
    are documents of their own. component_id is the least doc_id, null where all are null; kept are the rows of that
    id with the set of one class, so equal rows are kept together. Extra columns are ignored; an empty table gives an
    empty result.
    """
    return _components_of(docs, doc_id, text, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs, one for each component of ``near_duplicates``: of its kept rows, one of least text key.

    Rows without words that share a doc_id are one component; those with a null doc_id are components of their own.
    """
    bare = F.col(doc_id).isNull() & ~F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    found = _components_of(docs.where(~bare), doc_id, text, percent).where("kept")
    component = F.coalesce(F.hex("label"), F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    name, id_, key = fresh(docs, "_component"), fresh(docs, "_id"), fresh(docs, "_key")
    one = found.groupBy(component.alias(name)).agg(F.min(F.struct("doc_id", "key")).alias("x")).select(name, F.col("x.doc_id").alias(id_), F.col("x.key").alias(key))
    rows = docs.where(~bare).join(one, F.col(doc_id).eqNullSafe(F.col(id_)) & (text_key(F.col(text)) == F.col(key)))
    return rows.dropDuplicates([name]).select(columns_of(docs)).union(docs.where(bare).select(columns_of(docs)))


def _components_of(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, label, component_id, kept) per row: classes and links are known by fp, never by id."""
    floor = percent / 100 - MARGIN
    kind = docs.schema[doc_id].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.LongType()), *(T.StructField(n, t) for n, t in zip(SKETCH, (T.LongType(), T.BinaryType(), longs, longs), strict=True))])
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                made = sketch(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(made[n], k) for n, k in zip(SKETCH, kinds, strict=True))], names=schema.names)

    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema))
    # Classes of equal sets. first() is sound: members of a class have the same sketch.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = rows.where("n_shingles > 0").groupBy("fp").agg(least.alias("x"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes.select("fp", F.col("x.doc_id").alias("rep"), F.col("x.key").alias("key"), "sig", "bands"))
    words = [F.col("sig")[i].alias(f"s{i}") for i in range(SLOTS * BITS // 64)]
    signatures = classes.select("fp", *words)
    in_bands = classes.select(F.explode("bands").alias("bucket"), "fp")
    buckets = cut(in_bands.groupBy("bucket").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    shared = cut(spread(in_bands, "bucket", buckets)(buckets.select("bucket", "lead")).select("bucket", "fp", "lead"))

    # First links: each class with the first of its leaders that looks near enough.
    pairs = cut(shared.where("fp != lead").select("fp", "lead").distinct())
    other = signatures.select(F.col("fp").alias("lead"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(len(words))))
    pairs = spread(pairs, "lead")(other).join(signatures, "fp")
    pairs = pairs.withColumn("near", _estimate([(F.col(f"s{i}"), F.col(f"t{i}")) for i in range(len(words))])).where(F.col("near") >= floor)
    first = pairs.groupBy("fp").agg(F.min(F.struct((F.col("near") < percent / 100 - MARGIN / 4).alias("doubtful"), "lead")).alias("x"))
    first = cut(first.select("fp", F.col("x.lead").alias("lead")))

    # The full sets of all classes that share a bucket: the texts move once.
    sets = cut(_sets(docs, shared, classes, doc_id, text))
    sure = spread(first, "lead")(sets.select(F.col("fp").alias("lead"), F.col("shingles").alias("theirs"))).join(sets, "fp")
    sure = sure.withColumn("both", F.size(F.array_intersect("shingles", "theirs"))).where(100 * F.col("both") >= percent * (F.size("shingles") + F.size("theirs") - F.col("both")))
    first_links = components(sure.select(F.col("fp").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "fp")
    labels = cut(classes.select("fp").join(first_links, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))

    # Buckets that still hold several components: what looks near across components is tested on full sets.
    open_ = cut(shared.select("bucket", "fp").join(labels, "fp"))
    mixed = open_.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("major"), F.sum("n").alias("members"))
    members = spread(open_, "bucket", buckets)(mixed.where("major < members"))
    in_doubt = cut(_doubtful(cut(members), signatures, floor))
    left = in_doubt.join(signatures, "fp").join(sets, "fp")

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.column_stack([group[f"s{i}"].to_numpy().view(np.uint64) for i in range(SLOTS * BITS // 64)])
        root = {x: x for x in group.label}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        names, shingles, bucket = group.label.to_list(), group.shingles.to_list(), group.bucket.to_numpy()
        own, within = group.own.to_numpy(), group.i.iat[0] == group.j.iat[0]
        for x in range(len(group)):
            near = estimates(sig[x : x + 1], sig[:x])[0] >= floor
            for y in np.flatnonzero(near & (bucket[:x] == bucket[x]) & (within | (own[:x] != own[x]))):
                if top(names[x]) != top(names[y]) and linked(shingles[x], shingles[y], percent):
                    found.append((names[x], names[y]))
                    root[top(names[x])] = top(names[y])
        return pd.DataFrame(found, columns=["a", "b"])

    many = 4 * partitions(docs.sparkSession)
    more = cut(heavy_groups(left, many, *_BLOCK_KEYS).applyInPandas(confirm, "a binary, b binary").distinct())
    final = labels
    if more.limit(1).count():
        final = cut(relabelled(labels, components(more).select(F.col("node").alias("label"), F.col("label").alias("least")), "least"))
    # A component goes by its least id, or null; the rows of that id in the class that holds it are kept.
    named = final.join(classes.select("fp", "rep"), "fp")
    firsts = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("x"))
    named = spread(final, "label")(firsts).select("fp", "label", F.col("x.rep").alias("least"), (F.col("x.fp") == F.col("fp")).alias("is_first"))
    out = spread(rows.select("doc_id", "key", "n_shingles", "fp"), "fp")(named, "left")
    out = out.select("doc_id", "key", "n_shingles", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "is_first")
    return out.withColumn("kept", F.coalesce("is_first", F.lit(True)) & F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("is_first")


def _doubtful(shared: DataFrame, signatures: DataFrame, floor: float) -> DataFrame:
    """(bucket, pack, i, j, own, fp, label) of the classes that look near to one of another component in their bucket.

    Buckets that differ in nothing but their band hold the same pairs; the first of them stands for all.
    """
    alike = shared.groupBy("bucket").agg(F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("xor"), F.first("members").alias("members"))
    chosen = alike.groupBy("sum", "xor", "members").agg(F.min("bucket").alias("bucket"))
    members = spread(shared, "bucket")(chosen.select("bucket"))
    rows = _blocks(cut(members)).join(signatures, "fp")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.column_stack([group[f"s{i}"].to_numpy().view(np.uint64) for i in range(SLOTS * BITS // 64)])
        near = estimates(sig, sig) >= floor
        label = pd.factorize(group["label"])[0]
        near &= label[:, None] != label[None, :]
        bucket = group["bucket"].to_numpy()
        near &= bucket[:, None] == bucket[None, :]
        if group.i.iat[0] != group.j.iat[0]:
            own = group.own.to_numpy()
            near &= own[:, None] != own[None, :]
        return group.loc[near.any(1), names]

    names = ["bucket", *_BLOCK_KEYS, "own", "fp", "label"]
    return heavy_groups(rows, 4 * partitions(rows.sparkSession), *_BLOCK_KEYS).applyInPandas(run, rows.select(*names).schema)
