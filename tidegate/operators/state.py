"""Keyed state: token buckets, sessions and registries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.operators import scan

#: The service's own bucket.
MAX_TOKENS, PER_SECOND = 60.0, 20.0


class Bucket:
    """Tokens at a time; a request takes one or is denied."""

    def __init__(self, most: float, rate: float):
        self.most, self.rate, self.tokens, self.last = most, rate, most, None

    def allow(self, micros: int) -> bool:
        if self.last is not None:
            self.tokens = min(self.most, self.tokens + (micros - self.last) / 1e6 * self.rate)
        self.last = micros
        if self.tokens >= 1.0:
            self.tokens -= 1.0
            return True
        return False


def token_bucket(df: DataFrame, ts: str, id: str, key: str | None = None, most: float = MAX_TOKENS, rate: float = PER_SECOND) -> DataFrame:
    """Rows (key, id, allowed) by one bucket, or one for each ``key``, in order of ts and id. Keys and ids are of any type;
    null is a key of its own.

    A bucket is a sequence by nature, so one for everybody is one task; its rows stream through in sorted order
    and only the bucket is held. Buckets by key are dealt out.
    """
    rows = df.select((F.col(key) if key else F.lit(0)).alias("key"), F.col(id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for batch in batches:
            keys, micros, out = batch.column("key").to_pylist(), batch.column("micros").to_pylist(), []
            for k, m in zip(keys, micros, strict=True):
                if bucket is None or k != at:
                    at, bucket = k, Bucket(most, rate)
                out.append(bucket.allow(m))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(out, pa.bool_())], names=["key", "id", "allowed"])

    return rows.repartition("key").sortWithinPartitions("key", "micros", "id").mapInArrow(run, rows.drop("micros").schema.add("allowed", "boolean"))


def service_bucket(df: DataFrame, ts: str, id: str, most: float = MAX_TOKENS, rate: float = PER_SECOND, range_rows: int | None = None, key: str | None = None, start: list | None = None, end: list | None = None) -> DataFrame:
    """Rows (id, allowed) by one bucket for everybody, or (key, id, allowed) by one for each ``key``, in order of ts and id, by many tasks,
    whatever share of the rows one key has. A row without a time takes nothing and gets null; a null key is one of its own.

    Tokens are whole units here (see ``ServiceBucket``): where ``token_bucket`` rounds a sum of doubles, this one is exact. ``start`` is the
    state that an earlier batch has put into its ``end``; by key there is none.
    """
    rows = df.select(*([F.col(key).alias("key")] if key else []), F.col(id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    bucket, by = scan.ServiceBucket(most, rate), ["key"] if key else []
    timed = scan.scanned(rows.where("micros IS NOT NULL"), [*by, "micros", "id"], scan.Keyed(bucket, "key") if key else bucket, start, "allowed", T.BooleanType(), range_rows, end)
    return timed.select(*by, "id", "allowed").unionByName(rows.where("micros IS NULL").select(*by, "id", F.lit(None).cast("boolean").alias("allowed")))


def numbered(df: DataFrame, key: str, order: list[str], name: str, range_rows: int | None = None) -> DataFrame:
    """The rows of each key numbered from 1 in order, whatever share of the rows one key has."""
    return scan.scanned(df, [key, *order], scan.Keyed(scan.Numbered(), key), None, name, T.LongType(), range_rows)


def queue_outcome(df: DataFrame, ts: str, id: str, arrives: Column, depth: int = 100, range_rows: int | None = None) -> DataFrame:
    """Rows (id, accepted) of a queue of at most ``depth``: where ``arrives`` is true an event is put in, unless the queue is full;
    where it is false the host takes one, and accepted is null. In order of ts and id, by many tasks; a null time comes first."""
    rows = df.select(F.col(id).alias("id"), F.col(ts).alias("ts"), arrives.alias("arrives"))
    return scan.scanned(rows, ["ts", "id"], scan.BoundedQueue(depth), 0, "accepted", T.BooleanType(), range_rows).select("id", "accepted")


def as_of(requests: DataFrame, versions: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Requests (id, registry, at) with version: of the versions (version, registry, at) of their registry the last no later than
    they are, by (at, version); null before the first.

    Both logs are put into one order of registry and time, and the last version is carried along it, over the ends of ranges
    too, so a registry that everybody asks for takes as many tasks as it has ranges.
    """
    row = lambda df, kind, id, version: df.select("registry", "at", F.lit(kind).alias("kind"), id.cast("string").alias("id"), version.cast("string").alias("own"))
    both = row(versions, 0, F.col("version"), F.col("version")).unionByName(row(requests, 1, F.col("id"), F.lit(None))).withColumn("number", F.coalesce(F.col("own").try_cast("long"), F.lit(0)))
    found = scan.scanned(both, ["registry", "at", "kind", "number", "id"], scan.Carried("registry", "own"), [None, None], "version", T.StringType(), range_rows)
    kinds = requests.schema["id"].dataType, versions.schema["version"].dataType
    return found.where("kind = 1").select(F.col("id").cast(kinds[0]).alias("id"), "registry", "at", F.col("version").cast(kinds[1]).alias("version"))


def session_outcomes(log: DataFrame, range_rows: int | None = None) -> DataFrame:
    """(id, http) of a log (session_id, at, id, verb) of creations, deletions and requests, each by the state that its session has when it comes,
    in order of at and id: 200 for a creation and where the session is open, else 404.

    Without a session id a request passes and a deletion is 400. The state is carried along the sorted log, so a session with very many
    rows takes as many tasks as it has ranges.
    """
    rows = log.select("session_id", "at", "id", "verb")
    free = F.coalesce("session_id", F.lit("")) == ""
    own = F.when(F.col("verb") == "create", "open").when(F.col("verb") == "delete", "closed")
    found = scan.scanned(rows.where(~free).withColumn("own", own), ["session_id", "at", "id"], scan.Carried("session_id", "own", before=True), [None, None], "state", T.StringType(), range_rows)
    judged = found.select("id", F.when((F.col("verb") == "create") | F.coalesce(F.col("state") == "open", F.lit(False)), 200).otherwise(404).alias("http"))
    return judged.unionByName(rows.where(free).select("id", F.when(F.col("verb") == "delete", 400).otherwise(200).alias("http")))


def latest(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"__last.{v}").alias(v) for v in values])


def session_state(log: DataFrame, key: str, order: list[str], event: str, deleted: Column) -> DataFrame:
    """(key, last_event, last_activity, active) of each session: active unless its last event deletes it."""
    last = latest(log, key, order, [event, order[0]])
    return last.select(key, F.col(event).alias("last_event"), F.col(order[0]).alias("last_activity"), (~deleted).alias("active"))


def session_id() -> Column:
    """A random identifier in the form of a UUID of version 4; another one whenever it is computed, so store it."""
    return F.expr("uuid()")


def sessions_created(requests: DataFrame, version: Column, at: Column) -> DataFrame:
    """Requests that open a session, with the row of state that each inserts: the id goes back in the answer's header."""
    return requests.select("*", session_id().alias("session_id"), version.alias("protocol_version"), F.lit(True).alias("initialized"), at.alias("created_at"), at.alias("last_activity"))


def session_check(requests: DataFrame, sessions: DataFrame, sid: str) -> DataFrame:
    """Requests with http: 200 without a session id or with that of an active session, else 404."""
    active = sessions.where("active").select(F.col("sid").alias("__sid"))
    found = requests.join(active, F.col(sid) == F.col("__sid"), "left")
    return found.withColumn("http", F.when((F.coalesce(F.col(sid), F.lit("")) == "") | F.col("__sid").isNotNull(), 200).otherwise(404)).drop("__sid")


def close_outcome(sid: Column, known: Column) -> Column:
    """What a request to delete a session gets: 400 without an id, 404 for an unknown one, else 200."""
    return F.when(F.coalesce(sid, F.lit("")) == "", 400).when(~known, 404).otherwise(200)


def is_registry(payload: Column) -> Column:
    """A registry replaces another only as a JSON array."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("ARRAY"), F.lit(False))


def replace_outcome(payload: Column, registry: str | Column) -> Column:
    """Null where a version replaces the registry, else the error that it gets."""
    name = F.lit(registry) if isinstance(registry, str) else registry
    return F.when(~is_registry(payload), F.concat(F.lit("Invalid JSON array for "), name))


def registry_latest(versions: DataFrame, registry: str, version: list[str], payload: str) -> DataFrame:
    """The last valid payload of each registry; invalid ones leave the old in place."""
    return latest(versions.where(is_registry(F.col(payload))), registry, version, [*version, payload])
