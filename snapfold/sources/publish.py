"""Publishing: tables replaced as a whole, several outputs with one completion mark, and a log of runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "run string, job string, state string, counts string, at timestamp"


def publish(outputs: Mapping[str, DataFrame], folder: str, summary: Mapping | None = None) -> str:
    """Write all outputs under a new version, then the summary, last: a version without a summary does not exist for readers."""
    version = uuid.uuid4().hex
    spark = next(iter(outputs.values())).sparkSession
    for name, df in outputs.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    mark = spark.range(1).select(F.lit(version).alias("version"), F.lit(json.dumps(dict(summary or {}), sort_keys=True)).alias("summary"), F.current_timestamp().alias("at"))
    mark.coalesce(1).write.mode("append").json(f"{folder}/summaries")
    return version


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An output of the latest complete version: the whole of it was replaced at once."""
    last = spark.read.schema("version string, summary string, at timestamp").json(f"{folder}/summaries").agg(F.max_by("version", F.struct("at", "version")).alias("v")).first().v
    return spark.read.parquet(f"{folder}/{last}/{name}")


@contextmanager
def logged_run(spark: SparkSession, folder: str, job: str) -> Iterator[dict]:
    """Append a row as a run starts, and one as it completes, with its counts, or fails. Failures are raised again."""
    run, counts = uuid.uuid4().hex, {}

    def note(state: str) -> None:
        row = spark.range(1).select(F.lit(run).alias("run"), F.lit(job).alias("job"), F.lit(state).alias("state"), F.lit(json.dumps(counts, sort_keys=True)).alias("counts"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(folder)

    note("started")
    try:
        yield counts
    except Exception:
        note("failed")
        raise
    note("completed")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row a run: its job, last state and counts."""
    log = spark.read.schema(_LOG).parquet(folder)
    order = F.struct("at", (F.col("state") != "started").alias("done"))
    return log.groupBy("run", "job").agg(F.max_by("state", order).alias("state"), F.max_by("counts", order).alias("counts"))
