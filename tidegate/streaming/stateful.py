"""Operators that keep state between batches: deadlines of requests, live sessions, numbered delivery; and what their state shows.

Each keeps a few numbers a key in the RocksDB state store, and takes the rows of one key and batch in order of their time. A stream that is
started again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEST, ANSWER = 0, 1


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


class _Open(StatefulProcessor):
    """The open request of an id, and a timer for its deadline."""

    def __init__(self, seconds: int):
        self.wait = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at long, deadline long")

    def _closed(self, deadline: int) -> None:
        self.handle.deleteTimer(deadline // 1000 + 1)
        self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.open.get() if self.open.exists() else None
        for micros, kind, id in sorted((r.micros, r.kind, r.id or "") for r in rows):
            if found is not None and micros > found[1]:  # the watermark hasn't come there, but the log has
                self._closed(found[1])
                yield Row(request_id=key[0], outcome="timeout", answer_id=None)
                found = None
            if kind == REQUEST and found is None:
                found = (micros, micros + self.wait)
                self.open.update(found)
                self.handle.registerTimer(found[1] // 1000 + 1)
            elif kind == ANSWER and found is not None:
                self._closed(found[1])
                yield Row(request_id=key[0], outcome="answered", answer_id=id)
                found = None
            elif kind == ANSWER:
                yield Row(request_id=key[0], outcome="dropped", answer_id=id)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.open.exists():
            self.open.clear()
            yield Row(request_id=key[0], outcome="timeout", answer_id=None)

    def close(self) -> None:
        pass


def answered(requests: DataFrame, answers: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """(request_id, outcome, answer_id) as things happen: requests (request_id, at) and answers (request_id, answer_id, at).

    An answer goes out with the batch that it comes in; a request without one times out as soon as the watermark, or a later message
    of the same id, is past its deadline. An answer that finds no open request comes out as dropped, so that it can be counted: a second one, a
    late one, one without request. Rows later than the watermark are lost.
    """
    row = lambda df, kind, id: df.select(F.col("request_id").cast("string").alias("request_id"), F.lit(kind).alias("kind"), id.cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"))
    both = row(requests, REQUEST, F.lit(None)).unionByName(row(answers, ANSWER, F.col("answer_id"))).withWatermark("at", late)
    keyed = both.where("request_id IS NOT NULL AND at IS NOT NULL").withColumn("micros", _micros("at"))
    return keyed.groupBy("request_id").transformWithState(_Open(seconds), "request_id string, outcome string, answer_id string", "Append", "EventTime")


class _Session(StatefulProcessor):
    """A session from its creation to its deletion, and its calls by kind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "created long, last_activity long")
        self.calls = handle.getMapState("calls", "verb string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for micros, _, id, verb in sorted((r.micros, r.id, r.id, r.verb) for r in rows):
            known = self.session.exists()
            if verb == "create":
                self.session.update((micros, micros))
            elif known and verb == "delete":
                self.session.clear()
                self.calls.clear()
            elif known:
                self.session.update((self.session.get()[0], micros))
                before = self.calls.getValue((verb,))
                self.calls.updateValue((verb,), ((before[0] if before else 0) + 1,))
            yield Row(id=id, http=200 if known or verb == "create" else 404)

    def close(self) -> None:
        pass


def sessions_judged(log: DataFrame) -> DataFrame:
    """(id, http) of a log (session_id, at, id, verb) of creations, deletions and requests, each by the session's state at its time.

    A request without a session id passes, a deletion without one is 400, and neither touches any state.
    """
    rows = log.select(F.coalesce("session_id", F.lit("")).alias("session_id"), F.col("id").cast("long").alias("id"), "verb", _micros("at").alias("micros"))
    free = rows.where("session_id = ''").select("id", F.when(F.col("verb") == "delete", 400).otherwise(200).alias("http"))
    kept = rows.where("session_id <> ''").groupBy("session_id").transformWithState(_Session(), "id long, http int", "Append", "None")
    return kept.unionByName(free)


class _Numbers(StatefulProcessor):
    """How many messages a stream has had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.sent.get()[0] if self.sent.exists() else 0
        for _, id, message in sorted((r.micros, r.message_id, r.message) for r in rows):
            n += 1
            yield Row(stream_id=key[0], seq=n, message_id=id, message=message)
        self.sent.update((n,))

    def close(self) -> None:
        pass


def numbered(sent: DataFrame) -> DataFrame:
    """Messages (stream_id, message_id, at, message) of each stream numbered from 1 in the order of batches, and of time within one; the
    numbers go on after a restart."""
    rows = sent.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("message_id").cast("long").alias("message_id"), _micros("at").alias("micros"), F.coalesce("message", F.lit("")).alias("message"))
    return rows.groupBy("stream_id").transformWithState(_Numbers(), "stream_id long, seq long, message_id long, message string", "Append", "None")


def kept_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a stopped stream keeps under a name, one row a key: the key's and the value's columns. Read from its checkpoint, by Spark's reader of
    state stores."""
    store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return store.select("key.*", "value.*")


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(request_id, at, deadline) of the requests that a stopped stream of ``answered`` still waits for."""
    return kept_state(spark, checkpoint, "open").withColumns({c: F.timestamp_micros(c) for c in ("at", "deadline")})


def active_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, created, last_activity) of the sessions that a stopped stream of ``sessions_judged`` knows."""
    return kept_state(spark, checkpoint, "session").withColumns({c: F.timestamp_micros(c) for c in ("created", "last_activity")})


def shut_down(open_: DataFrame, streams: Column) -> DataFrame:
    """What the requests that a stopped stream kept get: an event where their answer is a stream, else 503."""
    return open_.select("request_id", F.lit("shutdown").alias("outcome"), F.when(~streams, 503).alias("http"))
