"""The service's way of a message, from its receipt to what goes out, in one place for batches and streams."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import jsonrpc
from tidegate.operators import predicates, state

#: Bodies of what is refused before a message is read, and of an unknown session.
FAR, UNKNOWN, TOO_MANY, NO_SESSION = "Forbidden: invalid Origin", "Unauthorized: invalid or missing Bearer token", "Too Many Requests", "Session not found"
#: Methods that the host answers, what it gets told, and the parameter that has to be there.
TO_HOST = {"tools/call": ("ToolCall", "name"), "resources/read": ("ResourceRead", "uri"), "prompts/get": ("PromptGet", "name")}
LISTS = {"tools/list": "tools", "resources/list": "resources", "prompts/list": "prompts"}
SINKS = ("answers", "events", "errors")


def _passing(received: DataFrame, token: str) -> DataFrame:
    """What origin and token let through: only these take from the bucket."""
    return received.where(predicates.allowed_origin(F.col("origin")) & predicates.authorized(F.col("authorization"), token))


def judged(
    received: DataFrame, token: str, server: str = "tidegate", version: str = "1.0", registries: Mapping[str, str] | None = None,
    bucket: tuple[float, float] | None = None, sessions: DataFrame | None = None, start: list | None = None, end: list | None = None,
) -> DataFrame:
    """Received messages (request_id, at, origin, authorization, accept, session_id, body) with sink, http, event and message.

    Origin, then token, then rate, then reading, then session, then method, then parameters: the first that fails answers. A rate is kept
    where ``bucket``, size and tokens a second, is given, with its state from ``start`` and into ``end``; sessions are looked up where a frame of
    the known ones (session_id) is. ``answers`` are what the service says
    itself, with the pages of ``registries`` (name -> JSON array), ``events`` what the host gets, ``errors`` what is refused. A notification is
    taken with 200 and no message. Bodies are parsed once. Null headers count as missing, a null body as no JSON.
    """
    m = F.col("__m")
    rows = received.withColumn("__allowed", F.lit(None).cast("boolean"))
    if bucket is not None:
        took = state.service_bucket(_passing(received, token), "at", "request_id", *bucket, start=start, end=end)
        rows = received.join(took.withColumnsRenamed({"id": "__took", "allowed": "__allowed"}), F.col("request_id") == F.col("__took"), "left").drop("__took")
    known = rows.withColumn("__known", F.lit(True))
    if sessions is not None:
        active = sessions.select(F.col("session_id").alias("__active")).distinct()
        known = rows.join(active, F.col("session_id") == F.col("__active"), "left").withColumn("__known", (F.coalesce("session_id", F.lit("")) == "") | F.col("__active").isNotNull()).drop("__active")
    rows = known.withColumn("__m", jsonrpc.message(F.col("body")))
    rows = rows.withColumn("__object", F.coalesce(jsonrpc.kind_of(m) == "OBJECT", F.lit(False))).withColumn("__has_id", jsonrpc.has_key(F.col("body"), "id"))
    rows = rows.withColumns({"__method": F.coalesce(jsonrpc.text_of(m, "$.method"), F.lit("")), "__id": F.try_variant_get(m, "$.id", "variant"), "__name": jsonrpc.text_of(m, "$.params.name"), "__uri": jsonrpc.text_of(m, "$.params.uri"),
        "__cursor": F.coalesce(jsonrpc.text_of(m, "$.params.cursor"), F.lit("")), "__arguments": F.try_variant_get(m, "$.params.arguments", "variant"), "__token": F.try_variant_get(m, "$.params._meta.progressToken", "variant")})
    method, id, event_id = F.col("__method"), F.col("__id"), F.col("request_id").cast("string")
    outcome = F.when(~F.col("__object"), "parse_error").when(~F.col("__known") & (method != "initialize"), "no_session").otherwise(predicates.outcome(method, F.col("__has_id")))
    lacking = F.lit(False)
    for known, (_, parameter) in TO_HOST.items():
        lacking = lacking | (method == known) & predicates.missing(F.col(f"__{parameter}"))
    rows = rows.withColumn("__outcome", F.when(lacking & (outcome == method), "missing").otherwise(outcome))
    out = F.col("__outcome")
    refused = F.when(~predicates.allowed_origin(F.col("origin")), 403).when(~predicates.authorized(F.col("authorization"), token), 401).when(~F.col("__allowed"), 429)
    rows = rows.withColumn("http", F.coalesce(refused, F.when(out == "no_session", 404), F.lit(200)))

    sink = F.when((F.col("http") != 200) | out.isin("parse_error", "method_not_found", "missing"), "errors").when(out.isin(*TO_HOST), "events").otherwise("answers")
    plain = lambda text: jsonrpc.dumped(F.struct(F.lit(text).alias("error")))
    nobody = F.lit(None).cast("string")
    denied = F.when(F.col("http") == 403, plain(FAR)).when(F.col("http") == 401, jsonrpc.error(nobody, jsonrpc.SERVER_ERROR, F.lit(UNKNOWN))).when(F.col("http") == 429, plain(TOO_MANY)).when(F.col("http") == 404, plain(NO_SESSION))
    needed = F.when(method == "resources/read", predicates.required(F.col("__uri"), "uri")).otherwise(predicates.required(F.col("__name"), "name"))
    error = (
        F.when(denied.isNotNull(), denied).when(out == "parse_error", jsonrpc.error(nobody, jsonrpc.PARSE_ERROR, F.lit("Parse error")))
        .when(out == "missing", jsonrpc.error(id, jsonrpc.INVALID_PARAMS, needed)).when(out == "method_not_found", jsonrpc.error(id, jsonrpc.METHOD_NOT_FOUND, F.concat(F.lit("Method not found: "), method)))
    )
    arguments = F.coalesce(F.col("__arguments"), F.parse_json(F.lit("{}")))
    told = (
        F.when(out == "tools/call", jsonrpc.tool_event(event_id, F.col("__name"), arguments, F.col("__token")))
        .when(out == "resources/read", jsonrpc.resource_event(event_id, F.col("__uri"))).when(out == "prompts/get", jsonrpc.prompt_event(event_id, F.col("__name"), arguments))
    )
    yes = F.struct(F.lit(True).alias("listChanged"))
    hello = F.struct(F.struct(yes.alias("prompts"), yes.alias("resources"), yes.alias("tools")).alias("capabilities"), F.lit(jsonrpc.PROTOCOL_VERSION).alias("protocolVersion"), F.struct(F.lit(server).alias("name"), F.lit(version).alias("version")).alias("serverInfo"))
    said = F.when(out == "initialize", jsonrpc.result(id, hello)).when(out == "ping", jsonrpc.result(id, F.parse_json(F.lit("{}"))))
    for known, name in LISTS.items():
        page = jsonrpc.page_of(F.lit((registries or {}).get(name, "[]")), F.col("__cursor"))
        items = F.transform(page["items"], lambda x: F.parse_json(x))
        last = jsonrpc.result(id, F.struct(items.alias(name)))
        more = F.struct(page["next"].alias("nextCursor"), items.alias(name)) if name > "nextCursor" else F.struct(items.alias(name), page["next"].alias("nextCursor"))
        said = said.when(out == known, F.when(page["next"].isNull(), last).otherwise(jsonrpc.result(id, more)))
    message = F.when(sink == "errors", error).when(sink == "events", told).otherwise(said)
    event = F.when(sink == "events", F.element_at(F.create_map(*[F.lit(x) for k, (e, _) in TO_HOST.items() for x in (k, e)]), out))
    return rows.select("request_id", "at", sink.alias("sink"), "http", event.alias("event"), message.alias("message"))


def serve(received: DataFrame, path: str, checkpoint: str, token: str, **more):
    """Starts a stream that writes each sink's rows to a folder of its own, a sub-folder a batch, and beside them the state of the bucket. A batch
    that comes again begins with the state that it began with and writes its own sub-folders anew, so it adds nothing."""
    return received.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path, token, **more)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket_after(spark: SparkSession, path: str, number: int) -> list | None:
    return json.loads(spark.read.text(f"{path}/bucket/batch={number}").first().value) if number >= 0 else None


def write_batch(batch: DataFrame, number: int, path: str, token: str, bucket: tuple[float, float] | None = None, **more) -> None:
    spark, end = batch.sparkSession, []
    start = _bucket_after(spark, path, number - 1) if bucket is not None else None
    out = judged(batch, token, bucket=bucket, start=start, end=end, **more).persist()
    try:
        for sink in SINKS:
            out.where(F.col("sink") == sink).drop("sink").write.mode("overwrite").parquet(f"{path}/{sink}/batch={number}")
        if bucket is not None:
            spark.createDataFrame([(json.dumps(end[0]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bucket/batch={number}")
    finally:
        out.unpersist()
