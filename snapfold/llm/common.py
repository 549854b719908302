"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, made from ``name``. Case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none (as in tests) gets one made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="snapfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables that ``cut`` has written, and other folders made, in this process and that nobody has released.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later plans start here, and lost executors cost no rework."""
    path = f"{shared_dir(df.sparkSession)}/snapfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register(path: str) -> None:
    """A folder that somebody else fills goes with the tables of ``cut`` when they are released."""
    _written.append(path)


def release(spark: SparkSession, keep: int = 0, but: int = 0) -> None:
    """Delete the tables that ``cut`` wrote after the first ``keep``, once nothing reads them any more; the last ``but`` stay."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end = len(_written) - but
    for name in _written[keep:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _written[keep:end]


def written() -> int:
    """How many tables of ``cut`` there are: a later ``release`` can keep them."""
    return len(_written)


def spread(big: DataFrame, key: str, counts: DataFrame | None = None, least: int = 64) -> Callable[..., DataFrame]:
    """A function (small, how) that joins ``big`` on one column, although many rows of ``big`` may share a key.

    Rows of a key that holds more than a fair share of ``big`` are dealt over several parts, and ``small``, which has
    few rows a key, gets a copy of that key's rows for each part. At most 4 keys a partition can be that frequent, so
    their list is broadcast. Null keys match nothing. Where no key is that frequent it is a plain join. counts may give
    what is known already of the keys' rows: a written table (key, n).
    """
    deal, width = "_deal", "_width"
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(width)) if counts is None else counts.select(key, F.col("n").alias(width))
    total, most = counts.agg(F.sum(width), F.max(width)).first()
    share = max(least, (total or 0) // (4 * partitions(big.sparkSession)) + 1)
    if (most or 0) <= share:
        return lambda small, how="inner": big.join(small, key, how)
    hot = F.broadcast(cut(counts.where(F.col(width) > share).select(key, F.ceil(F.col(width) / share).cast("int").alias(width))))
    parts = F.coalesce(F.col(width), F.lit(1))
    left = big.join(hot, key, "left").withColumn(deal, F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop(width)

    def join(small: DataFrame, how: str = "inner") -> DataFrame:
        right = small.join(hot, key, "left").withColumn(deal, F.explode(F.sequence(F.lit(0), parts - 1))).drop(width)
        return left.join(right, [key, deal], how).drop(deal)

    return join


def heavy_groups(df: DataFrame, groups: int, *keys: str):
    """df grouped by keys of about ``groups`` values, each of which costs much time for few bytes.

    A number of partitions that is asked for is kept, so such groups are not put together in a few tasks.
    """
    return df.repartition(max(1, min(2 * groups, 4 * partitions(df.sparkSession))), *keys).groupBy(*keys)


def padded(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """df with its vectors filled up with zeros to ``dims`` components."""
    short = F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(vector))
    return df.withColumn(vector, F.when(F.size(vector) < dims, F.concat(vector, short)).otherwise(F.col(vector)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
