"""Streaming twins of the incremental jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.operators.upsert import supersede

#: Parts of a state that batches rewrite one by one.
BUCKETS = 64
_BUCKET, _VERSIONS = "_bucket", "bucket int, version long"


def read_state(spark, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def supersede_stream(stream: DataFrame, state: str, checkpoint: str, subject: list[str], row: list[str], at: str, buckets: int = BUCKETS):
    """Keep in ``state`` the rows of each subject's latest publication. Subjects are dealt into ``buckets``.

    A batch reads and writes only the buckets of its subjects, each as a new version, then names these versions current.
    A batch that runs twice gives the same state: superseding is idempotent. ``subject`` must be part of ``row`` or
    follow from it; the number of buckets must stay as it was.
    """
    schema = stream.schema

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*subject), F.lit(buckets)).cast("int")
        versions = _versions(spark, state)
        if versions.where(F.col("version") >= epoch).limit(1).count():
            return
        batch = batch.dropna(subset=[*subject, at])  # they belong to no subject or no publication
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        existing = _rows(spark, state, schema, [r for r in _latest(versions) if r.bucket in touched])
        fresh = supersede(existing, batch, subject, row, at)
        fresh.withColumn(_BUCKET, bucket).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{state}/v{epoch}")
        named = spark.createDataFrame([(b, epoch) for b in touched], _VERSIONS)
        named.coalesce(1).write.mode("append").parquet(f"{state}/current")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, state: str) -> DataFrame:
    return read_state(spark, f"{state}/current", _VERSIONS)


def _latest(versions: DataFrame) -> list:
    """The current version of each bucket that has one."""
    return versions.groupBy("bucket").agg(F.max("version").alias("version")).collect()


def _rows(spark, state: str, schema, latest: list) -> DataFrame:
    paths = [f"{state}/v{r.version}/{_BUCKET}={r.bucket}" for r in latest]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark, state: str, schema) -> DataFrame:
    """The rows of the current versions of all buckets."""
    return _rows(spark, state, schema, _latest(_versions(spark, state)))


def windowed_counts(stream: DataFrame, at: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and values by event-time window and kind; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
