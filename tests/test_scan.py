"""Recurrences by many tasks against one pass over all rows."""

import random
import time
from fractions import Fraction

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegate.operators import paging, scan, state


def in_order(times, most, rate):
    """One bucket in exact numbers."""
    tokens, last, out = Fraction(str(most)), None, []
    for t in times:
        if last is not None:
            tokens = min(Fraction(str(most)), tokens + Fraction(t - last, 1_000_000) * Fraction(str(rate)))
        last = t
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out


def by_ranges(recurrence, start, rows, cuts):
    """What scanned() does, without Spark."""
    out, s = [], start
    for a, b in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
        if a == b:
            continue
        part = rows.slice(a, b - a)
        summary = recurrence.summary()
        for batch in part.to_batches(max_chunksize=3):
            summary.feed(batch)
        out += recurrence.replayed(s, part)
        s = recurrence.after(s, summary.packed())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 7, 50, 333, 1000, 2500, 9999]), max_size=60), st.sampled_from([(3.0, 1000.0), (1.0, 300.0), (0.5, 100.0), (2.5, 777.0), (6.0, 123.45), (60.0, 20.0)]), st.lists(st.integers(0, 60), max_size=6))
def test_bucket_by_ranges(gaps, bucket, cuts):
    times, t = [], 1_700_000_000_000_000
    for g in gaps:
        t += g
        times.append(t)
    rows = pa.table({"micros": pa.array(times, pa.int64())})
    cuts = sorted(min(c, len(times)) for c in cuts)
    assert by_ranges(scan.ServiceBucket(*bucket), None, rows, cuts) == in_order(times, *bucket)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([True, True, False, None]), max_size=50), st.integers(1, 5), st.lists(st.integers(0, 50), max_size=6))
def test_queue_by_ranges(moves, depth, cuts):
    waiting, want = 0, []
    for m in moves:
        want.append(waiting < depth if m else None)
        waiting = min(depth, waiting + 1) if m else waiting if m is None else max(0, waiting - 1)
    assert by_ranges(scan.BoundedQueue(depth), 0, pa.table({"arrives": pa.array(moves, pa.bool_())}), sorted(min(c, len(moves)) for c in cuts)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 5]), st.sampled_from([0, 1, 400, 2500])), max_size=50), st.lists(st.integers(0, 50), max_size=7))
def test_keys_by_ranges(moves, cuts):
    moves, t, rows = sorted(moves, key=lambda m: (m[0] is not None, m[0] or 0)), 0, []
    for k, gap in moves:
        t = t + gap if rows and rows[-1][0] == k else gap
        rows.append((k, t))
    table, cuts = pa.table({"key": pa.array([k for k, _ in rows], pa.int64()), "micros": pa.array([t for _, t in rows], pa.int64())}), sorted(min(c, len(rows)) for c in cuts)
    want, numbers = [], []
    for key in dict.fromkeys(k for k, _ in rows):
        own = [t for k, t in rows if k == key]
        want += in_order(own, 2.0, 1000.0)
        numbers += range(1, len(own) + 1)
    assert by_ranges(scan.Keyed(scan.ServiceBucket(2.0, 1000.0), "key"), None, table, cuts) == want
    assert by_ranges(scan.Keyed(scan.Numbered(), "key"), None, table, cuts) == numbers


def test_maps_stay_small_in_every_regime():
    """An overloaded bucket is never full, an idle one always, one in balance hovers: pieces stay few in each."""
    rng = random.Random(1)
    for load in (0.2, 0.95, 1.0, 1.05, 5):
        bucket, t = scan.ServiceBucket(60.0, 20.0), 0
        m = bucket.summary()
        times = []
        for _ in range(3000):
            t += round(rng.expovariate(20 * load) * 1_000_000)
            times.append(t)
        m.feed(pa.record_batch({"micros": pa.array(times, pa.int64())}))
        assert len(m.packed()) < 20_000, load


def test_bucket_over_200_ranges(spark):
    rng, t, rows = random.Random(7), 1_700_000_000_000_000, []
    for i in range(20_000):
        t += rng.choice([0, 10, 500, 20_000, 60_000, 4_000_000 if rng.random() < 0.01 else 40_000])
        rows.append((i, t))
    df = spark.createDataFrame(rows, "id long, t long").select("id", F.timestamp_micros("t").alias("ts")).repartition(9)
    df = df.unionByName(spark.createDataFrame([(-1,)], "id long").withColumn("ts", F.lit(None).cast("timestamp")))
    got = {r.id: r.allowed for r in state.service_bucket(df, "ts", "id", 60.0, 20.0, range_rows=100).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i, _ in rows] == in_order([t for _, t in rows], 60.0, 20.0)
    assert {True, False} == set(got.values())


def test_one_key_has_most_rows(spark):
    rng, rows, t = random.Random(8), [], 0
    for i in range(5000):
        t += rng.choice([10, 30_000, 90_000])
        rows.append((i, "hot" if rng.random() < 0.7 else rng.choice([None, "a", "b"]), t))
    df = spark.createDataFrame(rows, "id long, k string, t long").withColumn("ts", F.timestamp_micros("t"))
    got = {r.id: r.allowed for r in state.service_bucket(df, "ts", "id", 5.0, 15.0, range_rows=90, key="k").collect()}
    for key in ("hot", None, "a", "b"):
        own = [(i, t) for i, k, t in rows if k == key]
        assert [got[i] for i, _ in own] == in_order([t for _, t in own], 5.0, 15.0)
    numbers = state.numbered(df, "k", ["t", "id"], "n", range_rows=70).collect()
    assert len(numbers) == 5000 and all(sorted(r.n for r in numbers if r.k == k) == list(range(1, 1 + sum(x == k for _, x, _ in rows))) for k in ("hot", None, "a", "b"))


def test_queue_over_ranges(spark):
    rng = random.Random(3)
    moves = [(i, rng.random() < (0.8 if i % 2000 < 900 else 0.2)) for i in range(6000)]
    df = spark.createDataFrame(moves, "id long, a boolean").withColumn("ts", F.timestamp_seconds("id"))
    got = {r.id: r.accepted for r in state.queue_outcome(df, "ts", "id", F.col("a"), 20, range_rows=50).collect()}
    waiting = 0
    for i, a in moves:
        assert got[i] == (waiting < 20 if a else None)
        waiting = min(20, waiting + 1) if a else max(0, waiting - 1)
    assert {True, False, None} == set(got.values())


def test_versions_carried_over_ranges(spark):
    """One registry has nearly all requests, and its last version lies many ranges back."""
    versions = [(k, "tools" if k % 10 else "prompts", float(t)) for k, t in enumerate([1, 5, 5, 40, 41, 90])] + [(50, "rare", 10.0)]
    requests = [(i, "tools" if i % 50 else "rare" if i % 100 else "never", i / 20) for i in range(2000)]
    timed = lambda rows, id: spark.createDataFrame(rows, f"{id} long, registry string, s double").select(id, "registry", F.timestamp_seconds("s").alias("at"))
    got = {r.id: r.version for r in state.as_of(timed(requests, "id"), timed(versions, "version"), range_rows=60).collect()}
    for i, registry, s in requests:
        known = [(t, v) for v, r, t in versions if r == registry and t <= s]
        assert got[i] == (max(known)[1] if known else None)
    assert len(got) == 2000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, ts timestamp, a boolean")
    assert state.service_bucket(none, "ts", "id").collect() == []
    assert state.queue_outcome(none, "ts", "id", F.col("a")).collect() == []
    assert state.as_of(none.select("id", F.lit("r").alias("registry"), F.col("ts").alias("at")), none.select(F.col("id").alias("version"), F.lit("r").alias("registry"), F.col("ts").alias("at"))).collect() == []


@pytest.mark.parametrize("partitions", ["4", "2000"])
def test_positions_cost_what_the_rows_cost(spark, partitions):
    """Neither the driver nor the plan grows with the session's shuffle partitions."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), "id")
    paging.positions(df, ["k"]).count()  # code is compiled
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        began = time.monotonic()
        assert paging.positions(df, ["k"], range_rows=10_000).agg(F.sum("pos")).first()[0] == 100_000 * 99_999 // 2
        assert len(paging.page(df, ["k"], 60_000, near=1000).collect()) == 50
        assert time.monotonic() - began < (10 if partitions == "4" else 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
