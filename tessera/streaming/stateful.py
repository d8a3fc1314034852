"""Requests and leases as streams with state for each key, dropped by event-time timers.

`requests` tells for each request of an idempotency key whether it is accepted (the first of its key), a replay (equal
to the accepted one) or a conflict (the key again with another body). The state is the accepted request's id and body hash.
It is forgotten when the watermark passes the key's last request by `keep`; the next request counts as first again. Keys are
dealt to buckets by hash, and a bucket's keys share one state row, one timer and one call a micro-batch: a call costs some
milliseconds, whether for one key or for a thousand.

`leases` follows grants, heartbeats and writes of resources. A grant with a newer token takes the lease over, a
heartbeat of the current token extends it, rows of older tokens are fenced off, and a lease without a heartbeat for
`most` is told as expired when the watermark passes its end.

Rows later than the watermark's delay are dropped by the stream itself. Rows of a key within a micro-batch are taken in the
order (time, id), so a batch, bounded by the files it reads, decides the same however its rows are dealt. State lives
in the checkpoint: a stream that is started again goes on where it stood.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState

#: The state store that keeps named states and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of one micro-batch, in order."""
    return sorted(rows, key=lambda r: (r.millis, r.request))


def timed(stream: DataFrame, columns: list[str | Column], delay: str) -> DataFrame:
    """The columns with the watermark on `at`, and `millis`, the same time as a number."""
    return stream.select(*columns, F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay).withColumn("millis", F.unix_millis("at"))


class Timed(StatefulProcessor):
    """One state row and one timer a key."""

    state = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.state)

    def due(self, at: int) -> None:
        """Move the key's only timer."""
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Leases(Timed):
    state = "token long, until long"

    def __init__(self, most: int) -> None:
        self.most = most

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        token, until = self.known.get() if self.known.exists() else (None, None)
        for row in in_order(rows):
            if token is not None and row.token < token:
                state = "fenced"
            elif row.kind == "grant":
                state = "held" if row.token == token else "granted"
                token, until = row.token, row.millis + self.most
            elif row.token != token:
                state = "unknown"
            elif row.millis > until:
                state = "late"
            else:
                state = "held"
                if row.kind == "beat":
                    until = max(until, row.millis + self.most)
            yield Row(key=key[0], request=row.request, token=row.token, state=state)
        if token is not None:
            self.known.update((token, until))
            self.due(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        token, _ = self.known.get()
        # The token stays known, so that older ones are still fenced off.
        yield Row(key=key[0], request=None, token=token, state="expired")


#: The state of a bucket of request keys.
KNOWN = "known array<struct<key:string,request:string,digest:string,due:bigint>>"


def first_wins(keep: int):
    """Tells the rows of one bucket of keys in a micro-batch from its state: for each key the accepted request and when it is due
    to be forgotten."""

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (request, digest, due) for k, request, digest, due in state.get[0]} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows.iloc[np.lexsort((rows["place"], rows["millis"]))]
            places: dict = {}
            codes = np.fromiter((places.setdefault(k, len(places)) for k in rows["key"]), np.int64, len(rows))
            ids, digests, millis = (rows[c].to_numpy() for c in ("request", "digest", "millis"))
            start = np.unique(codes, return_index=True)[1]
            last = np.full(len(places), millis[0])
            np.maximum.at(last, codes, millis)
            new = np.array([k not in known for k in places])
            for k, at, end in zip(places, start, last.tolist()):
                request, digest, _ = known.get(k) or (ids[at], digests[at], None)
                known[k] = (request, digest, end + keep)
            of = lambda i: np.array([known[k][i] for k in places], dtype=object)[codes]
            told = np.where(digests == of(1), "replay", "conflict").astype(object)
            told[start[new]] = "accepted"
            yield pd.DataFrame({"key": rows["key"].to_numpy(), "request": ids, "state": told, "first": of(0)})
        # Keys that are due are forgotten after the rows of their micro-batch, as a timer of their own would have it.
        mark = state.getCurrentWatermarkMs()
        known = {k: v for k, v in known.items() if v[2] >= mark}
        if known:
            state.update(([(k, *v) for k, v in known.items()],))
            state.setTimeoutTimestamp(min(v[2] for v in known.values()))
        else:
            state.remove()

    return run


def requests(stream: DataFrame, delay: str, keep: timedelta, buckets: int = 2048) -> DataFrame:
    """(key, request, state, first) of a stream (key, request, digest, at). The number of buckets belongs to the checkpoint."""
    use_state_store(stream.sparkSession)
    # Ids travel as text, as pandas has no nulls among integers; their place in the order is a number.
    rows = timed(stream, ["key", F.col("request").cast("string").alias("request"), F.coalesce("request", F.lit(-(2**63))).alias("place"), "digest"], delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    told = rows.groupBy("bucket").applyInPandasWithState(
        first_wins(int(keep.total_seconds() * 1000)), "key string, request string, state string, first string", KNOWN, "append", "EventTimeTimeout"
    )
    return told.select("key", F.col("request").cast("bigint").alias("request"), "state", F.col("first").cast("bigint").alias("first"))


def leases(stream: DataFrame, delay: str, most: timedelta) -> DataFrame:
    """(key, request, token, state) of a stream (key, request, kind, token, at) of grants, beats and writes."""
    use_state_store(stream.sparkSession)
    rows = timed(stream, ["key", "request", "kind", "token"], delay)
    return rows.groupBy("key").transformWithState(Leases(int(most.total_seconds() * 1000)), "key string, request long, token long, state string", "Append", "EventTime")
