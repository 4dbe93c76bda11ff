"""Streaming versions of correlation, token buckets, sessions and fan-out, each compared with its batch result.

Every stream casts its time to TIMESTAMP, on which watermarks work, and takes rows that are late beyond its
watermark as lost, like an answer to a request that is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegate.functions import jsonrpc
from tidegate.operators import correlate
from tidegate.operators.state import Bucket, is_registry
from tidegate.sources.tables import opened

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def received(spark: SparkSession, path: str) -> DataFrame:
    """Messages as they come, one a row of Parquet files."""
    return opened(spark).readStream.schema("request_id string, at timestamp, origin string, authorization string, accept string, session_id string, body string").parquet(path)


def correlated(requests: DataFrame, answers: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Requests (key, request_id, at) with each answer in time; a request without any comes out, with nulls, once the
    watermark is past its limit. What is still open when a stream stops is closed by ``drained``."""
    left = requests.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    right = answers.select(F.col("key").alias("answer_key"), "answer_id", F.col("at").cast("timestamp").alias("answered_at")).withWatermark("answered_at", late)
    on = (F.col("key") == F.col("answer_key")) & (F.col("answered_at") >= F.col("at")) & (F.col("answered_at") <= F.col("at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(right, on, "leftOuter").select("key", "request_id", "at", "answer_id", "answered_at")


def answered_once(requests: DataFrame, answers: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Requests with their first answer in time, or null: one row each, once the watermark is past its limit."""
    first = F.min_by("answer_id", F.struct("answered_at", "answer_id")).alias("answer_id")
    return correlated(requests, answers, seconds, late).groupBy("key", "request_id", "at").agg(first)


def drained(requests: DataFrame, emitted: DataFrame, streams: Column | None = None) -> DataFrame:
    """Requests that a stopped stream left open: each gets the shutdown outcome, as an event where its answer is a stream,
    else as 503."""
    left = requests.join(emitted.select("request_id").distinct(), "request_id", "left_anti").withColumn("outcome", F.lit("shutdown"))
    return left if streams is None else left.withColumn("http", F.when(~streams, 503))


class _Buckets(StatefulProcessor):
    """A token bucket for each key, its state two numbers."""

    def __init__(self, most: float, rate: float):
        self.most, self.rate = most, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("bucket", "tokens double, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bucket = Bucket(self.most, self.rate)
        if self.kept.exists():
            bucket.tokens, bucket.last = self.kept.get()
        # one batch's rows of one key: order within it is by time and id
        batch = pd.concat(list(rows)).sort_values(["micros", "id"])
        allowed = [bucket.allow(int(m)) for m in batch["micros"]]
        self.kept.update((bucket.tokens, bucket.last))
        yield pd.DataFrame({"key": batch["key"].to_numpy(), "id": batch["id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def token_bucket(log: DataFrame, ts: str, id: str, key: str, most: float, rate: float) -> DataFrame:
    """Rows (key, id, allowed) as they come; needs the RocksDB state store."""
    rows = log.select(F.col(key).alias("key"), F.col(id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    return rows.groupBy("key").transformWithStateInPandas(_Buckets(most, rate), rows.drop("micros").schema.add("allowed", "boolean"), "Append", "None")


def session_state(log: DataFrame, key: str, ts: str, id: str, event: str) -> DataFrame:
    """The last event of each session so far, for an update or complete sink."""
    return log.groupBy(key).agg(F.max_by(event, F.struct(ts, id)).alias("last_event"), F.max(ts).alias("last_activity"))


def idle_sessions(log: DataFrame, key: str, ts: str, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """Runs of a key's rows with no gap above ``gap_seconds``, each out once the watermark is past its end."""
    gap = f"{gap_seconds} seconds 1 microsecond"  # a window leaves out its end
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n")).select(key, "started", "ended", "n")


def changes(versions: DataFrame, registry: str, payload: str) -> DataFrame:
    """A notification for each version that replaces a registry; invalid ones make none."""
    return versions.where(is_registry(F.col(payload))).withColumn("message", jsonrpc.changed(F.col(registry)))


def fanned_out(messages: DataFrame, streams: DataFrame) -> DataFrame:
    """Streamed messages (message_id, at) with the open streams of a table (stream_id, opened, closed), null ``closed`` being open still."""
    return correlate.fanned_out(messages, streams, 3600)


def logged(lines: DataFrame, path: str, checkpoint: str):
    """Starts appending log lines, a text column named value, to files."""
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pushed(events: DataFrame, path: str, checkpoint: str, depth: int = 100):
    """Starts handing events (source, event, data) to the host as files of at most ``depth`` rows."""
    rows = events.select("source", "event", "data")
    return rows.writeStream.format("parquet").option("path", path).option("maxRecordsPerFile", depth).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
