"""Streams that keep state, over several batches and a restart, against their batch results."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidegate.operators import correlate, state
from tidegate.plans import catalog
from tidegate.streaming import frames, service, stateful

SF = "/root/testdata/sf0.001"
DAY0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY0 + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS_DB)


class Log:
    """A table that grows by batches, and a stream of it that takes one batch at a time."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        df = rows if hasattr(rows, "schema") else self.spark.createDataFrame(rows, self.schema)
        before = set(os.listdir(self.path)) if os.path.isdir(self.path) else set()
        df.coalesce(1).write.mode("append").parquet(self.path)
        for f in set(os.listdir(self.path)) - before:
            os.utime(os.path.join(self.path, f), (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    @property
    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    @property
    def table(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


def run(df, tmp_path, name="out"):
    """All that is there, as far as it has come in: rows pile up in a folder over restarts."""
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


REQUESTS, ANSWERS = "request_id string, at timestamp", "request_id string, answer_id string, at timestamp"


def test_deadlines_over_batches_and_a_restart(spark, tmp_path):
    q, a = Log(spark, tmp_path / "q", REQUESTS), Log(spark, tmp_path / "a", ANSWERS)
    out = lambda: {(r.request_id, r.outcome, r.answer_id) for r in run(stateful.answered(q.stream, a.stream, 60), tmp_path).collect()}
    q.add([("r1", at(0)), ("r2", at(1)), ("r3", at(2)), ("r4", at(3))])
    a.add([("r1", "a1", at(30)), ("r1", "a2", at(31)), ("nobody", "a3", at(5))])
    got = out()
    # the answer goes out with its batch; its second and the one without request are counted as dropped
    assert got == {("r1", "answered", "a1"), ("r1", "dropped", "a2"), ("nobody", "dropped", "a3")}
    assert {r.request_id for r in stateful.pending(spark, str(tmp_path / "out-cp")).collect()} == {"r2", "r3", "r4"}
    # the stream is started anew for each of the next batches
    q.add([("r5", at(40))])
    a.add([("r2", "a4", at(61)), ("r3", "a5", at(63))])
    got2 = out() - got
    assert got2 == {("r2", "answered", "a4"), ("r3", "timeout", None), ("r3", "dropped", "a5")}
    q.add([("r9", at(100_000))])
    a.add([("nobody", "a9", at(100_000))])
    q.add([("r9b", at(100_001))])
    a.add([("nobody", "a9b", at(100_001))])
    got3 = out() - got - got2
    assert {("r4", "timeout", None), ("r5", "timeout", None)} <= got3
    left = stateful.pending(spark, str(tmp_path / "out-cp"))
    assert {(r.request_id, r.deadline) for r in left.collect()} == {("r9", at(100_060)), ("r9b", at(100_061))}
    ended = stateful.shut_down(left, F.col("request_id") == "r9").collect()
    assert {(r.request_id, r.outcome, r.http) for r in ended} == {("r9", "shutdown", None), ("r9b", "shutdown", 503)}
    # with what the stop gives, each request has one outcome, the same as in a batch
    of = lambda df, *c: df.select(F.col("request_id").alias("key"), *c, F.col("at"))
    batch = {r.request_id: (r.outcome, r.answer_id) for r in correlate.correlated(of(q.table, "request_id"), of(a.table, "answer_id"), 60).collect()}
    once = {r: (o, i) for r, o, i in got | got2 | got3 if o != "dropped"}
    assert once == {r: v for r, v in batch.items() if r not in ("r9", "r9b")}


def test_sessions_live_and_end(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "session_id string, at timestamp, id long, verb string")
    out = lambda: {r.id: r.http for r in run(stateful.sessions_judged(log.stream), tmp_path).collect()}
    log.add([("s", at(0), 1, "create"), ("s", at(1), 2, "tools/call"), ("t", at(1), 3, "ping"), (None, at(2), 4, "ping"), ("", at(2), 5, "delete"), ("u", at(2), 6, "create")])
    assert out() == {1: 200, 2: 200, 3: 404, 4: 200, 5: 400, 6: 200}
    log.add([("s", at(5), 7, "delete"), ("u", at(6), 8, "ping"), ("u", at(7), 9, "ping")])
    out()
    assert {(r.session_id, r.last_activity) for r in stateful.active_sessions(spark, str(tmp_path / "out-cp")).collect()} == {("u", at(7))}
    log.add([("s", at(9), 10, "ping"), ("s", at(10), 11, "delete"), ("s", at(11), 12, "create"), ("s", at(12), 13, "ping")])
    got = out()
    assert {i: got[i] for i in range(7, 14)} == {7: 200, 8: 200, 9: 200, 10: 404, 11: 404, 12: 200, 13: 200}
    batch = state.session_outcomes(log.table, range_rows=3)
    assert got == {r.id: r.http for r in batch.collect()}


def test_frames_in_order_once(spark, tmp_path):
    schema = "stream_id long, message_id long, at timestamp, message string"
    log, rng, path = Log(spark, tmp_path / "log", schema), random.Random(1), str(tmp_path / "frames")
    sent = [(rng.randint(1, 4), i, at(i), f"m{i}") for i in range(300)]
    for part in (sent[:100], sent[100:180]):
        log.add(part)
    frames.deliver(stateful.numbered(log.stream), path, str(tmp_path / "cp")).awaitTermination(240)
    log.add(sent[180:])
    frames.deliver(stateful.numbered(log.stream), path, str(tmp_path / "cp")).awaitTermination(240)
    made = "stream_id long, seq long, message_id long, message string"
    rows = frames.delivered(spark, path, made)
    want = sorted((r.stream_id, r.seq, r.message_id) for r in correlate.delivery_order(log.table).collect())
    assert sorted((r.stream_id, r.seq, r.message_id) for r in rows.collect()) == want
    assert {r.batch for r in rows.select("batch").distinct().collect()} == {0, 1, 2}
    # a batch that comes again, and one that breaks off, leave nothing
    writer = frames.FrameWriter(path, rows.select("stream_id", "seq", "message_id", "message").schema)
    again = [writer.write(iter(rows.drop("batch").limit(5).collect()))]
    writer.commit(again, 2)
    writer.abort([writer.write(iter(rows.drop("batch").limit(5).collect())), None], 3)
    writer.write(iter(rows.drop("batch").limit(5).collect()))  # never listed
    assert sorted((r.stream_id, r.seq, r.message_id) for r in frames.delivered(spark, path, made).collect()) == want


def test_service_from_end_to_end(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    received = catalog.received(events).withColumn("at", F.col("at").cast("timestamp"))
    schema = "request_id long, at timestamp, origin string, authorization string, accept string, session_id string, body string"
    log, path = Log(spark, tmp_path / "log", schema), str(tmp_path / "served")
    registries = {"tools": '[{"name":"a"},{"name":"b"}]'}
    thirds = [received.where((F.col("at") >= F.lit(a)) & (F.col("at") < F.lit(b))) for a, b in ((DAY0, at(10 * 86400)), (at(10 * 86400), at(20 * 86400)), (at(20 * 86400), at(40 * 86400)))]
    for part in thirds:
        log.add(part)
    lists = [(10_000 + k, at(50 * 86400 + 2000 * k), None, "Bearer t", "", "s" if k == 7 else "x" if k in (8, 9) else "", body) for k, body in enumerate(['{"id":1,"method":"tools/list"}', '{"id":2,"method":"prompts/list"}', '{"id":3,"method":"initialize"}', '{"id":4,"method":"resources/read"}', '{"id":5,"method":"prompts/get","params":{"name":"x","arguments":{"a":[1]}}}', '{"id":6,"method":"tools/call","params":{"name":"y","_meta":{"progressToken":7}}}', None, '{"id":"p","method":"notifications/initialized"}', '{"id":1,"method":"ping"}', '{"id":1,"method":"initialize"}'])]
    log.add(lists)
    more = {"registries": registries, "bucket": (3.0, 0.0005), "sessions": spark.createDataFrame([("s",)], "session_id string")}
    service.serve(log.stream, path, str(tmp_path / "cp"), "t", **more).awaitTermination(240)
    read = lambda: {s: sorted((r.request_id, r.http, r.event, r.message) for r in spark.read.parquet(f"{path}/{s}").collect()) for s in service.SINKS}
    got = read()
    batch = service.judged(log.table, "t", **more).collect()
    key = lambda r: (r.request_id, r.http, r.event, r.message)
    assert got == {s: sorted((key(r) for r in batch if r.sink == s), key=lambda t: t[0]) for s in service.SINKS}
    assert all(got.values()) and sum(map(len, got.values())) == events.count() + len(lists)
    said = {r.request_id: (r.sink, r.message) for r in batch}
    assert said[10_000] == ("answers", '{"id":1,"jsonrpc":"2.0","result":{"tools":[{"name":"a"},{"name":"b"}]}}')
    assert said[10_001] == ("answers", '{"id":2,"jsonrpc":"2.0","result":{"prompts":[]}}')
    assert said[10_003] == ("errors", '{"error":{"code":-32602,"message":"Missing \'uri\' in params"},"id":4,"jsonrpc":"2.0"}')
    assert said[10_004] == ("events", '{"arguments":{"a":[1]},"id":"10004","name":"x","type":"prompt_get"}')
    assert said[10_005] == ("events", '{"arguments":{},"id":"10005","progressToken":7,"tool":"y","type":"tool_call"}')
    assert said[10_006][0] == "errors" and said[10_007] == ("answers", None) and said[10_008] == ("errors", '{"error":"Session not found"}') and said[10_009][0] == "answers"
    # the bucket's state goes on from batch to batch
    assert {r.http for r in batch} == {200, 401, 403, 404, 429} and all(any(r.http == 429 for r in spark.read.parquet(f"{path}/errors/batch={k}").collect()) for k in range(3))
    # the third batch comes again
    service.write_batch(thirds[2], 2, path, "t", **more)
    assert read() == got
