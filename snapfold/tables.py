"""Tables in the folder that driver and executors share: where long plans are cut, and what one job leaves to the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Tables that ``cut`` has written in this process and that nobody has released.
_written: list[str] = []


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="snapfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The path of a new folder there. It goes with the next ``release``."""
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written and read back: later plans start here, and lost executors cost no rework."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that was written here, once no result reads it any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table in a folder; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
