"""Streams against their batch forms: restarts, repeated and late rows."""

import datetime
import random

from pyspark.sql import functions as F

from snapfold.operators import matching
from snapfold.streaming import candidates, pairs

START = datetime.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_candidates_as_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    states = ["http_failed", "parse_failed", "parsed", "missing", "downloaded"]
    answers = sorted((START + datetime.timedelta(minutes=rng.randint(0, 20_000)), i % 9, i, rng.choice(states)) for i in range(60))
    schema = "at timestamp, key long, answer long, state string"
    folder = f"file://{tmp_path}"
    for part in (answers[:25], answers[25:45] + answers[40:45], answers[45:]):  # some answers come twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = candidates.candidate_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination()
    got = candidates.current(spark, f"{folder}/out")
    columns = ("key", "state", "failures", "retry_at", "at", "answer")
    assert rows(got, *columns) == rows(candidates.batch_states(spark.createDataFrame(answers, schema)), *columns)
    last = max(a[0] for a in answers)
    assert all(r.due == (r.retry_at is not None and r.retry_at <= last) for r in got.collect())
    late = [(START - datetime.timedelta(days=9), 1, 999, "http_failed")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    candidates.candidate_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert rows(candidates.current(spark, f"{folder}/out"), *columns) == rows(got, *columns)


def test_pairs_of_streams_equal_those_of_tables(spark, tmp_path):
    rng = random.Random(3)
    folder, schema = f"file://{tmp_path}", "key long, id long, at timestamp"
    side = lambda first: [(rng.choice([1, 2, None]), first + i, START + datetime.timedelta(days=rng.randint(0, 60), hours=rng.randint(0, 23))) for i in range(80)]
    sides = {"a": side(0), "b": side(1000)}
    for low, high in ((0, 25), (25, 40), (40, 99)):
        streams = []
        for name, all_ in sides.items():
            part = [r for r in all_ if low <= (r[2] - START).days < high]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
            streams.append(spark.readStream.schema(schema).parquet(f"{folder}/{name}"))
        query = pairs.run(pairs.candidates_stream(streams[0], streams[1].withColumnRenamed("id", "other"), "key", "at", "id", "other"), f"{folder}/pairs", f"{folder}/checkpoint")
        query.awaitTermination()
        assert pairs.late_rows(query) == 0
    a, b = (spark.createDataFrame(sides[n], schema) for n in "ab")
    want = matching.candidates(a, b.withColumnRenamed("id", "other"), "key", "at", "id", "other")
    columns = ("key", "id", "left_day", "other", "right_day")
    assert rows(spark.read.parquet(f"{folder}/pairs"), *columns) == rows(want, *columns)
    spark.createDataFrame([(1, 5000, START - datetime.timedelta(days=30))], schema).coalesce(1).write.mode("append").parquet(f"{folder}/a")
    streams = [spark.readStream.schema(schema).parquet(f"{folder}/{n}") for n in "ab"]
    query = pairs.run(pairs.candidates_stream(streams[0], streams[1].withColumnRenamed("id", "other"), "key", "at", "id", "other"), f"{folder}/pairs", f"{folder}/checkpoint")
    query.awaitTermination()
    assert pairs.late_rows(query) == 1 and spark.read.parquet(f"{folder}/pairs").where(F.col("id") == 5000).count() == 0


def test_a_candidate_asks_the_store_for_little():
    """One read, one update and the timers that change: what a key costs in a batch."""
    from pyspark.sql import Row

    calls = []

    class Store:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    hour, one = 3_600_000_000, candidates._Candidate(3, "6 hours")
    one.init(Store())
    answer = lambda n, state: Row(us=n * hour, answer=n, state=state)
    got = [next(iter(one.handleInputRows((7,), iter(rows), None))) for rows in ([answer(2, "http_failed"), answer(1, "parsed")], [answer(2, "http_failed"), answer(3, "parse_failed")], [answer(4, "parsed")])]
    assert [(r.key, r.state, r.failures, r.retry, r.answer) for r in got] == [(7, "http_failed", 1, 8 * hour, 2), (7, "parse_failed", 2, 15 * hour, 3), (7, "parsed", 0, None, 4)]
    ms = hour // 1000
    assert calls == ["get", "update", ("register", 8 * ms), "get", "update", ("delete", 8 * ms), ("register", 15 * ms), "get", "update", ("delete", 15 * ms)]
