import os

import pytest
from pyspark.sql import functions as F

from tidegate.functions import jsonrpc
from tidegate.operators import correlate, state
from tidegate.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def log(spark, tmp_path):
    """The log as a stream of eight files in order of time, and as a table."""
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "log"))
    # the source takes files in order of age
    for k, f in enumerate(sorted((tmp_path / "log").glob("part-*"))):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "log"))
    return table, stream


def rows(spark, df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def of(df, kind, id):
    return df.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias(id), F.col("ts").alias("at"))


def test_correlation(spark, log, tmp_path):
    table, stream = log
    got = rows(spark, flows.correlated(of(stream, "click", "request_id"), of(stream, "purchase", "answer_id"), 86400, "30 days"), tmp_path)
    batch = correlate.within(of(table, "click", "request_id"), of(table, "purchase", "answer_id"), 86400, "inner")
    pair = lambda df: sorted((r.request_id, r.answer_id) for r in df.where("answer_id IS NOT NULL").collect())
    assert pair(got) == pair(batch) and pair(got)
    open_ = flows.drained(of(table, "click", "request_id"), got).collect()
    assert {r.request_id for r in open_} | {r.request_id for r in got.collect()} == {r.request_id for r in of(table, "click", "request_id").collect()}


def test_one_answer_each(spark, log, tmp_path):
    """Each request comes out once, with its first answer in time, as soon as the watermark is past its limit."""
    table, stream = log
    got = rows(spark, flows.answered_once(of(stream, "click", "request_id"), of(stream, "purchase", "answer_id"), 86400), tmp_path)
    want = {r.request_id: r.answer_id for r in correlate.correlated(of(table, "click", "request_id"), of(table, "purchase", "answer_id"), 86400).collect()}
    found = {r.request_id: r.answer_id for r in got.collect()}
    assert len(found) == got.count() and found and all(want[i] == a for i, a in found.items())
    assert {None} < set(found.values())
    left = flows.drained(of(table, "click", "request_id"), got, F.col("request_id") % 2 == 0).collect()
    assert {r.request_id for r in left} == set(want) - set(found) and all((r.http is None) == (r.request_id % 2 == 0) for r in left)


def test_late_answers_are_dropped(spark, tmp_path):
    """An answer beyond the watermark, which holds a batch later, finds no request; one within it does."""
    at = lambda minute: f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00"
    table = lambda rows, id: spark.createDataFrame(rows, f"key string, {id} string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    for k, (asked, answered) in enumerate([([("a", "r1", at(0)), ("b", "r2", at(1))], [("a", "s1", at(2))]), ([("z", "r9", at(600))], [("z", "s9", at(601))]), ([("y", "r7", at(605))], [("y", "s7", at(606))]), ([("z", "r8", at(610))], [("b", "s2", at(3))])]):
        for name, found, id in (("q", asked, "request_id"), ("s", answered, "answer_id")):
            table(found, id).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            for f in (tmp_path / name).glob("part-*.parquet"):
                if f.stat().st_mtime > 1_700_000_100:
                    os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    read = lambda name, id: spark.readStream.schema(f"key string, {id} string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = rows(spark, flows.correlated(read("q", "request_id"), read("s", "answer_id"), 3600, "10 minutes"), tmp_path)
    found = {r.request_id: r.answer_id for r in got.collect()}
    assert found["r1"] == "s1" and found["r9"] == "s9" and "r2" in found and found["r2"] is None


def test_messages_and_events(spark, tmp_path):
    sent = spark.createDataFrame([(f"req_{i}", "", "", "", "", '{"id":1,"method":"ping"}') for i in range(250)], "request_id string, origin string, authorization string, accept string, session_id string, body string")
    sent.withColumn("at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    events = flows.received(spark, str(tmp_path / "in")).select(F.lit("server").alias("source"), F.lit("Request").alias("event"), F.col("body").alias("data"))
    flows.pushed(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "out").glob("part-*.parquet")]
    assert sum(files) == 250 and max(files) <= 100


def test_token_bucket(spark, log, tmp_path):
    table, stream = log
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKS_DB)
    got = rows(spark, flows.token_bucket(stream, "ts", "event_id", "user_id", 2.0, 0.00002), tmp_path)
    batch = state.token_bucket(table, "ts", "event_id", "user_id", 2.0, 0.00002)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.where("NOT allowed").count() > 0


def test_sessions(spark, log, tmp_path):
    table, stream = log
    got = rows(spark, flows.session_state(stream, "user_id", "ts", "event_id", "event_type"), tmp_path, "complete")
    batch = state.session_state(table, "user_id", ["ts", "event_id"], "event_type", F.lit(False))
    assert sorted((r.user_id, r.last_event) for r in got.collect()) == sorted((r.user_id, r.last_event) for r in batch.collect())


def test_idle_sessions(spark, log, tmp_path):
    table, stream = log
    got = {(r.user_id, r.started, r.n) for r in rows(spark, flows.idle_sessions(stream, "user_id", "ts", 21600), tmp_path).collect()}
    batch = {(r.user_id, r.started, r.n) for r in correlate.idle_sessions(table, "user_id", "ts", "event_id", 21600).withColumn("started", F.col("started").cast("timestamp")).collect()}
    # what the watermark, an hour behind the last row, has not passed stays open: nothing else
    last = table.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    ended = {(r.user_id, r.started.replace(tzinfo=None), r.n) for r in correlate.idle_sessions(table, "user_id", "ts", "event_id", 21600).where(F.col("ended").cast("timestamp") < F.lit(last) - F.expr("INTERVAL 8 HOURS")).collect()}
    assert got <= batch and {(a, b.replace(tzinfo=None), n) for a, b, n in got} >= ended


def test_changes_fan_out_and_log(spark, log, tmp_path):
    table, stream = log
    versions = lambda df: df.select("event_id", F.lit("tools").alias("registry"), F.when(F.col("event_id") % 2 == 0, F.lit("[]")).otherwise(F.lit("{"))  .alias("payload"))
    made = rows(spark, flows.changes(versions(stream), "registry", "payload"), tmp_path / "a")
    assert made.count() == table.where("event_id % 2 = 0").count()
    assert made.first().message == '{"jsonrpc":"2.0","method":"notifications/tools/list_changed"}'
    streams = table.where("event_type = 'signup'").select(F.col("event_id").alias("stream_id"), F.col("ts").alias("opened"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("closed"))
    messages = lambda df: df.where("event_type = 'error'").select(F.col("event_id").alias("message_id"), F.col("ts").alias("at"))
    got = rows(spark, flows.fanned_out(messages(stream), streams), tmp_path / "b")
    batch = correlate.fanned_out(messages(table), streams, 7200)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    q = flows.logged(stream.select(jsonrpc.log_line(F.col("ts"), F.col("event_type")).alias("value")), str(tmp_path / "lines"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.text(str(tmp_path / "lines")).count() == table.count()
