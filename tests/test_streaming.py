"""The followed quota: micro-batches, restarts, a failure between its two writes, hot minutes, empty input."""

import datetime as dt
import random
import tempfile

import pytest

from clarion.operators import quota
from clarion.streaming.quota import decisions, follow
from test_operators import brute_quota, requests

SCHEMA = "request_id int, ts timestamp, lane string"
LIMITS = {"production": 60, "evaluation": 15}


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{path}/arrived")


def run(spark, path, burst=3):
    follow(spark.readStream.schema(SCHEMA).parquet(f"{path}/arrived"), path, LIMITS, burst).awaitTermination()


def got(spark, path):
    rows = decisions(spark, path).collect()
    assert len({r.request_id for r in rows}) == len(rows)
    return {r.request_id: (r.accepted, r.reason) for r in rows}


def test_starts_anew_after_each_batch(spark):
    path, rows = tempfile.mkdtemp(prefix="spark-"), requests(600, 3)
    for k in range(3):
        arrive(spark, path, rows[200 * k : 200 * (k + 1)])
        run(spark, path)
    want = brute_quota(rows, LIMITS, 3)
    assert got(spark, path) == want and {"quota_exceeded", "rate_limited", None} == {x for _, x in want.values()}


def test_a_batch_that_fails_after_its_decisions_is_decided_again(spark, monkeypatch):
    from pyspark.errors import StreamingQueryException

    from clarion.streaming import quota as module

    path, rows = tempfile.mkdtemp(prefix="spark-"), requests(400, 5)
    arrive(spark, path, rows[:200])
    run(spark, path)
    arrive(spark, path, rows[200:])

    def lose_state(*args, **kwargs):
        out, after = quota.decided(*args, **kwargs)
        return out, after.selectExpr("*", "raise_error('lost') as x")

    with monkeypatch.context() as m, pytest.raises(StreamingQueryException):
        m.setattr(module, "decided", lose_state)
        run(spark, path)
    run(spark, path)
    assert got(spark, path) == brute_quota(rows, LIMITS, 3)


def test_a_minute_and_a_lane_that_were_full_before_stay_full(spark):
    at = dt.datetime(2024, 5, 1, 10, 0, tzinfo=dt.timezone.utc)
    rng = random.Random(8)
    # Nine tenths of all requests are of one minute, which three batches share; ties in time.
    rows = [(k, at + dt.timedelta(seconds=k // 20 if k < 540 else 60 * (k - 539)), rng.choice(["production", "evaluation"])) for k in range(600)]
    path = tempfile.mkdtemp(prefix="spark-")
    for a, b in ((0, 100), (100, 540), (540, 600)):
        arrive(spark, path, rows[a:b])
        run(spark, path)
    assert got(spark, path) == brute_quota(rows, LIMITS, 3)


def test_nothing_other_lanes_and_nulls(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    arrive(spark, path, [])
    run(spark, path)
    assert got(spark, path) == {}
    at = dt.datetime(2024, 5, 1, 10, 0, tzinfo=dt.timezone.utc)
    rows = [(1, at, "production"), (2, at, "other"), (3, at, None), (4, None, "production")]
    arrive(spark, path, rows)
    run(spark, path)
    want = {1: (True, None), 2: (False, "quota_exceeded"), 3: (False, "quota_exceeded"), 4: (False, "rate_limited")}
    assert got(spark, path) == want
    batch = quota.reserved(spark.createDataFrame(rows, SCHEMA), LIMITS)
    assert {r.request_id: (r.accepted, r.reason) for r in batch.collect()} == want
