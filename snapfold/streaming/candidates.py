"""States of candidates as a stream: the last answer, failures in a row and when to try again, kept by key with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from snapfold.operators import states
from snapfold.tables import stored

#: Failures in a row after which a candidate is given up; how long the first retry waits, doubling with each failure.
LIMIT, WAIT = 3, "6 hours"
FAILED = ("http_failed", "parse_failed", "invalid_document")
OUT = "key long, state string, failures int, retry_at timestamp, due boolean, at timestamp, answer long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: What is written of a key: times as microseconds.
_OUT = "key long, state string, failures int, retry long, due boolean, at long, answer long"


class _Candidate(StatefulProcessor):
    """Keeps a candidate's last answer. A timer is set for its retry, and fires once the watermark is past it.

    The retry's time is kept with the answer, so an old timer is deleted without asking which there are.
    """

    def __init__(self, limit: int, wait: str):
        self.limit, self.wait = limit, pd.Timedelta(wait).value // 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, failures int, at long, answer long, retry long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, failures, at, answer, old = self.last.get() or (None, 0, None, None, None)
        for r in sorted(rows, key=lambda r: (r["us"], r["answer"])):
            if at is not None and (r["us"], r["answer"]) <= (at, answer):
                continue  # an older answer that came late, or one that came twice
            failures = failures + 1 if r["state"] in FAILED else 0
            state, at, answer = r["state"], r["us"], r["answer"]
        retry = at + self.wait * 2 ** (failures - 1) if 0 < failures < self.limit else None
        self.last.update((state, failures, at, answer, retry))
        if old is not None:
            self.handle.deleteTimer(old // 1000)
        if retry is not None:
            self.handle.registerTimer(retry // 1000)
        yield self._row(key, state, failures, retry, False, at, answer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, failures, at, answer, retry = self.last.get()
        yield self._row(key, state, failures, retry, True, at, answer)

    def _row(self, key, state, failures, retry, due: bool, at, answer) -> Row:
        return Row(key=key[0], state="given_up" if failures >= self.limit else state, failures=failures, retry=retry, due=due, at=at, answer=answer)

    def close(self) -> None:
        pass


def candidate_stream(answers: DataFrame, table: str, checkpoint: str, limit: int = LIMIT, wait: str = WAIT, late: str = "0 seconds"):
    """Keep in ``table`` what is known of each candidate. answers: a stream of (key, at, answer, state), one row an answer.

    Changes of a batch are written under its number, so a batch that runs twice gives the same table. A query that is
    started again with the same checkpoint goes on where it was; answers that repeat or come late change nothing.
    """
    spark = answers.sparkSession
    provider, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(provider, PROVIDER)  # a query takes the setting that holds when it starts
    timed = answers.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    kept = timed.groupBy("key").transformWithState(_Candidate(limit, wait), _OUT, "Update", "EventTime")
    kept = kept.select("key", "state", "failures", F.timestamp_micros("retry").alias("retry_at"), "due", F.timestamp_micros("at").alias("at"), "answer")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    try:
        return kept.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last row of each candidate; a timer's row follows the answer's of its batch."""
    rows = stored(spark, table, f"{OUT}, batch long")
    newest = F.row_number().over(W.partitionBy("key").orderBy(F.desc("batch"), F.desc("due")))
    return rows.withColumn("_k", newest).where("_k = 1").select("key", "state", "failures", "retry_at", "due", "at", "answer")


def batch_states(answers: DataFrame, limit: int = LIMIT, wait: str = WAIT) -> DataFrame:
    """The same of a table of answers, but for ``due``: the last answer, and the failures since the last one that is none."""
    failed = F.col("state").isin(*FAILED)
    in_order = F.struct("at", "answer")
    good = answers.groupBy("key").agg(F.max(F.when(~failed, in_order)).alias("good"))
    each = answers.join(good, "key").where(F.col("good").isNull() | (in_order >= F.col("good")))
    last = each.groupBy("key").agg(F.max_by("state", in_order).alias("state"), F.count_if(failed).cast("int").alias("failures"), F.max(in_order).alias("last"))
    seconds = pd.Timedelta(wait).total_seconds()
    retry = F.when(F.col("failures").between(1, limit - 1), F.timestamp_seconds(F.unix_micros("last.at") / 1_000_000 + seconds * F.pow(F.lit(2), F.col("failures") - 1)))
    return last.select("key", F.when(F.col("failures") >= limit, "given_up").otherwise(F.col("state")).alias("state"), "failures", retry.alias("retry_at"), F.col("last.at").alias("at"), F.col("last.answer").alias("answer"))


def answers_of(df: DataFrame, key: str, at: str, answer: str, http_status, is_document, parse_error, parsed) -> DataFrame:
    """(key, at, answer, state) of rows that hold what came back."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(answer).cast("long").alias("answer"), states.state(http_status, is_document, parse_error, parsed).alias("state"))
