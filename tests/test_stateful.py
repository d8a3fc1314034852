"""Streams with state, restarted from their checkpoint between files."""

import datetime as dt
import os
import time

import pytest

from tessera.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    """Write rows as the next file of the log, then run the stream to its end; returns all rows of the sink."""

    def go(rows, schema, transform):
        (tmp_path / "log").mkdir(exist_ok=True)
        n = len(list((tmp_path / "log").glob("*.parquet")))
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(tmp_path / "log" / f"{n}.parquet", coerce_timestamps="us", index=False)
        os.utime(tmp_path / "log" / f"{n}.parquet", (time.time() - 100 + n,) * 2)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        out = transform(stream)
        query = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "sink"))
        query.awaitTermination()
        return sorted((tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "sink")).collect()), key=str)

    return go


REQUESTS = "key string, request long, digest string, at timestamp"


def test_requests_over_three_files(run):
    follow = lambda s: stateful.requests(s, "10 minutes", dt.timedelta(hours=1))
    first = [("a", 1, "x", at(0)), ("a", 2, "x", at(1)), ("a", 3, "y", at(2)), ("b", 4, "z", at(5)), ("b", 4, "z", at(5))]
    want = [("a", 1, "accepted", 1), ("a", 2, "replay", 1), ("a", 3, "conflict", 1), ("b", 4, "accepted", 4), ("b", 4, "replay", 4)]
    assert run(first, REQUESTS, follow) == sorted(want, key=str)
    # A new stream from the checkpoint: keys are remembered; b is seen again and lives longer.
    second = [("a", 5, "x", at(20)), ("b", 6, "y", at(58)), ("c", 7, "q", at(50)), ("c", 8, "r", at(49))]
    want += [("a", 5, "replay", 1), ("b", 6, "conflict", 4), ("c", 8, "accepted", 8), ("c", 7, "conflict", 8)]
    assert run(second, REQUESTS, follow) == sorted(want, key=str)
    # Watermark 48 minutes: request 9 is too late. Then time goes on, and a is forgotten, b not yet.
    third = [("a", 9, "x", at(30)), ("d", 10, "x", at(100))]
    want += [("d", 10, "accepted", 10)]
    assert run(third, REQUESTS, follow) == sorted(want, key=str)
    fourth = [("a", 11, "y", at(101)), ("b", 12, "z", at(102))]
    want += [("a", 11, "accepted", 11), ("b", 12, "replay", 4)]
    assert run(fourth, REQUESTS, follow) == sorted(want, key=str)


def test_request_keys_share_buckets(run, spark, tmp_path):
    """Thousands of keys take no more state rows, timers and calls than there are buckets."""
    rows = [(f"k{i % 5000}", i, "x" if i < 5000 else "xy"[i % 2], at(i / 5000)) for i in range(15_000)]
    out = run(rows, REQUESTS, lambda s: stateful.requests(s, "10 minutes", dt.timedelta(hours=1)))
    tell = lambda i: "accepted" if i < 5000 else "conflict" if i % 2 else "replay"
    assert out == sorted(((f"k{i % 5000}", i, tell(i), i % 5000) for i in range(15_000)), key=str)
    store = spark.read.format("statestore").load(str(tmp_path / "check"))
    assert store.count() <= 2048


def test_keys_of_one_bucket_are_forgotten_one_by_one(run):
    follow = lambda s: stateful.requests(s, "10 minutes", dt.timedelta(hours=1), buckets=1)
    first = [("a", 1, "x", at(0)), ("b", 2, "x", at(30)), (None, 3, "x", at(30)), (None, 4, "x", at(31)), ("d", 2**60 + 1, None, at(30)), ("d", 5, None, at(40))]
    want = [("a", 1, "accepted", 1), ("b", 2, "accepted", 2), (None, 3, "accepted", 3), (None, 4, "replay", 3), ("d", 2**60 + 1, "accepted", 2**60 + 1), ("d", 5, "replay", 2**60 + 1)]
    assert run(first, REQUESTS, follow) == sorted(want, key=str)
    # Watermark 75 minutes when this file is done: a was due at 60 and is forgotten, b at 90 is not.
    second = [("e", 6, "x", at(85))]
    want += [("e", 6, "accepted", 6)]
    assert run(second, REQUESTS, follow) == sorted(want, key=str)
    third = [("a", 7, "y", at(86)), ("b", 8, "y", at(86)), ("e", 9, "y", at(160))]
    want += [("a", 7, "accepted", 7), ("b", 8, "conflict", 2), ("e", 9, "conflict", 6)]
    assert run(third, REQUESTS, follow) == sorted(want, key=str)
    # Watermark 150 minutes: a and b, due at 146, are forgotten and e is not.
    fourth = [("a", 10, "z", at(151)), ("b", 11, "y", at(151)), ("e", 12, "x", at(151)), ("d", 13, "q", at(240))]
    want += [("a", 10, "accepted", 10), ("b", 11, "accepted", 11), ("e", 12, "replay", 6), ("d", 13, "accepted", 13)]
    assert run(fourth, REQUESTS, follow) == sorted(want, key=str)


LEASES = "key string, request long, kind string, token long, at timestamp"


def test_leases_expire_by_timer(run):
    follow = lambda s: stateful.leases(s, "1 minute", dt.timedelta(minutes=10))
    first = [("r", 1, "grant", 5, at(0)), ("r", 2, "beat", 5, at(8)), ("r", 3, "write", 4, at(9)), ("q", 4, "grant", 1, at(1)), ("q", 5, "beat", 9, at(2))]
    want = [("r", 1, 5, "granted"), ("r", 2, 5, "held"), ("r", 3, 4, "fenced"), ("q", 4, 1, "granted"), ("q", 5, 9, "unknown")]
    assert run(first, LEASES, follow) == sorted(want, key=str)
    # q ends at 11 and r at 18: at watermark 16 only q is told.
    second = [("s", 6, "grant", 1, at(17)), ("r", 7, "write", 5, at(17))]
    want += [("s", 6, 1, "granted"), ("r", 7, 5, "held"), ("q", None, 1, "expired")]
    assert run(second, LEASES, follow) == sorted(want, key=str)
    third = [("q", 8, "write", 0, at(18)), ("q", 9, "grant", 2, at(19)), ("r", 10, "grant", 6, at(40))]
    want += [("q", 8, 0, "fenced"), ("q", 9, 2, "granted"), ("r", 10, 6, "granted"), ("s", None, 1, "expired"), ("q", None, 2, "expired")]
    assert run(third, LEASES, follow) == sorted(want, key=str)
