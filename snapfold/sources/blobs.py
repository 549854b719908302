"""A store of contents by their hash: each is kept once, whoever brings it and how often."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.tables import cut, stored

#: Hexadecimal digits of a hash that name its part of the store.
DIGITS = 2
_MANIFEST = "hash string, bytes long, batch string"
_BLOBS = "hash string, content binary, prefix string"


class BlobStore:
    """Append-only, in a folder that driver and executors share.

    A batch of new contents is written in parts by the first digits of their hashes; then its hashes join the manifest,
    which makes it part of the store. Both writes are Spark's own, which commit task by task: a lost task leaves
    nothing, and a batch that breaks off before the manifest is not read and is written again by the next run.
    """

    def __init__(self, spark: SparkSession, folder: str, digits: int = DIGITS):
        self.spark, self.folder, self.digits = spark, folder.rstrip("/"), digits

    def hash_of(self, content: Column) -> Column:
        return F.sha2(content.cast("binary"), 256)

    def manifest(self) -> DataFrame:
        """(hash, bytes, batch) of all that is stored."""
        return stored(self.spark, f"{self.folder}/manifest", _MANIFEST)

    def put(self, df: DataFrame, content: str) -> int:
        """Store the contents that are not there yet, null ones aside; returns how many were new.

        Two runs at once may both store a content: readers take each hash once.
        """
        known = self.manifest().select("hash").distinct()
        hashes = df.where(F.col(content).isNotNull()).select(self.hash_of(F.col(content)).alias("hash"), F.col(content).cast("binary").alias("content"))
        # Hashes are few bytes: they decide what is new before any content moves, and of equal contents one moves.
        new = cut(hashes.select("hash").distinct().join(known, "hash", "left_anti"))
        n = new.count()
        if n:
            batch = uuid.uuid4().hex
            fresh = hashes.join(new, "hash", "left_semi").dropDuplicates(["hash"]).withColumn("prefix", F.left("hash", F.lit(self.digits)))
            path = f"{self.folder}/blobs/{batch}"
            fresh.repartition("prefix").write.partitionBy("prefix").parquet(path)
            written = self.spark.read.schema(_BLOBS).parquet(path)
            written.select("hash", F.octet_length("content").cast("long").alias("bytes"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.folder}/manifest")
        return n

    def get(self, hashes: DataFrame) -> DataFrame:
        """(hash, content) of the hashes asked for (one column) that are stored; only their parts of the store are read.

        A content that is not what its hash says is an error.
        """
        asked = cut(hashes.select(F.col(hashes.columns[0]).alias("hash")).dropna().distinct())
        places = cut(asked.join(self.manifest(), "hash").groupBy("hash").agg(F.min("batch").alias("batch")))
        rows = places.select("batch", F.left("hash", F.lit(self.digits)).alias("prefix")).groupBy("batch").agg(F.collect_set("prefix").alias("prefixes")).collect()  # a row a batch
        out = self.spark.createDataFrame([], "hash string, content binary")
        for r in rows:
            part = self.spark.read.schema(_BLOBS).parquet(f"{self.folder}/blobs/{r.batch}").where(F.col("prefix").isin(*r.prefixes))
            out = out.unionByName(part.join(places.where(F.col("batch") == r.batch).select("hash"), "hash", "left_semi").select("hash", "content"))
        damaged = F.raise_error(F.concat(F.lit("damaged content: "), F.col("hash")))
        return out.withColumn("content", F.when(self.hash_of(F.col("content")) == F.col("hash"), F.col("content")).otherwise(damaged.cast("binary")))
