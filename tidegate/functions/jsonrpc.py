"""JSON-RPC messages: tolerant reading, and envelopes with keys in sorted order and nulls kept.

Of a key that an object has twice the last value holds in sessions that ``tidegate.sources.tables.opened`` has prepared, as every
reader of the library does; elsewhere such an object is no JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.cursors import parsed_cursor

PROTOCOL_VERSION, PARSE_ERROR, METHOD_NOT_FOUND, INVALID_PARAMS, SERVER_ERROR = "2025-03-26", -32700, -32601, -32602, -32000


def dumped(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false"})


def message(json: Column) -> Column:
    """The text parsed, once for all that is read of it; null where it is no JSON."""
    return F.try_parse_json(json)


def kind_of(message: Column) -> Column:
    """OBJECT, ARRAY, VOID (null) or a scalar type; null where there is no message."""
    return F.regexp_extract(F.schema_of_variant(message), "^[A-Z]+", 0)


def text_of(message: Column, path: str) -> Column:
    """Text at a path of a message."""
    return F.try_variant_get(message, path, "string")


def kind(json: Column) -> Column:
    """OBJECT, ARRAY, VOID (null) or a scalar type; null where the text is no JSON."""
    return kind_of(message(json))


def has_key(json: Column, key: str) -> Column:
    """Whether an object has a key, even with a null."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def field(json: Column, path: str, default: str | None = None) -> Column:
    """Text at a path, or the default where there is none."""
    got = F.try_variant_get(F.try_parse_json(json), path, "string")
    return got if default is None else F.coalesce(got, F.lit(default))


def fields(json: Column) -> Column:
    """The fields of an object as a map of variants, whatever their names are; null where the text is no object."""
    return F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")


def argument(arguments: Column, name: str) -> Column:
    """An argument by name, any name, as JSON; null where there is none, or arguments are no object."""
    return F.to_json(F.try_element_at(fields(arguments), F.lit(name)))


def page_of(registry: Column, cursor: Column, size: int = 50) -> Column:
    """A page of a JSON array: items, each as JSON, and next, the cursor of what follows, null on the last page."""
    items = F.transform(F.coalesce(F.try_variant_get(F.try_parse_json(registry), "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.to_json(x))
    at = parsed_cursor(cursor)
    return F.struct(F.slice(items, at + 1, F.lit(size)).alias("items"), F.when(at + size < F.size(items), (at + size).cast("string")).alias("next"))


def parsed(text: Column, default: Column) -> Column:
    """The text as compact JSON with sorted keys; the default where it is empty or no JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), default)


def answer_body(json: Column, without: Sequence[str] = ("id", "status", "content_type")) -> Column:
    """The body of an answer: a string as it is, another value as JSON; an answer without one is its own body, without the
    fields that address it."""
    v = F.try_parse_json(json)
    body = F.try_variant_get(v, "$.body", "variant")
    text = F.when(F.schema_of_variant(body) == "STRING", F.try_variant_get(v, "$.body", "string")).otherwise(F.to_json(body))
    rest = F.to_json(F.map_filter(fields(json), lambda k, _: ~k.isin(*without)))
    return F.when(has_key(json, "body"), text).otherwise(rest)


#: What the host is told of an answer that can't be taken.
INVALID_ANSWER, ANSWER_WITHOUT_ID = "Invalid JSON in SendResponse", "Missing 'id' in SendResponse JSON"


def sent_answer(json: Column) -> Column:
    """An answer of the host as id, http (200 unless it says so), content_type (JSON unless it says so) and body; only error where it is no
    object or has no id."""
    m = message(json)
    whole, id = F.coalesce(kind_of(m) == "OBJECT", F.lit(False)), F.coalesce(text_of(m, "$.id"), F.lit(""))
    error = F.when(~whole, F.lit(INVALID_ANSWER)).when(id == "", F.lit(ANSWER_WITHOUT_ID))
    good = lambda x: F.when(error.isNull(), x)
    status = F.coalesce(F.try_variant_get(m, "$.status", "int"), F.lit(200))
    return F.struct(good(id).alias("id"), good(status).alias("http"), good(F.coalesce(text_of(m, "$.content_type"), F.lit("application/json"))).alias("content_type"), good(answer_body(json)).alias("body"), error.alias("error"))


def now_millis() -> Column:
    """The clock, in milliseconds since 1970."""
    return F.unix_millis(F.current_timestamp())


def array_length(json: Column) -> Column:
    return F.coalesce(F.json_array_length(json), F.lit(0))


def error(id: Column, code: Column | int, message: Column) -> Column:
    code = F.lit(code) if isinstance(code, int) else code
    return dumped(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error"), id.alias("id"), F.lit("2.0").alias("jsonrpc")))


def result(id: Column, value: Column) -> Column:
    return dumped(F.struct(id.alias("id"), F.lit("2.0").alias("jsonrpc"), value.alias("result")))


def text_content(text: Column) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit("text").alias("type")))


def text_result(text: Column, failed: Column) -> Column:
    """A tool's result: isError stands only where it is true."""
    plain = dumped(F.struct(text_content(text).alias("content")))
    return F.when(failed, dumped(F.struct(text_content(text).alias("content"), F.lit(True).alias("isError")))).otherwise(plain)


def wrapped(body: Column, key: str, otherwise: Column) -> Column:
    """The body as it is if it is an object with the key, else what it is wrapped in."""
    return F.when(has_key(body, key), body).otherwise(otherwise)


def tool_result(body: Column) -> Column:
    return wrapped(body, "content", text_result(body, F.lit(False)))


def resource_contents(text: Column, uri: Column, mime: str | Column = "application/json") -> Column:
    mime = F.lit(mime) if isinstance(mime, str) else mime
    return dumped(F.struct(F.array(F.struct(mime.alias("mimeType"), text.alias("text"), uri.alias("uri"))).alias("contents")))


def resource_result(body: Column, uri: Column) -> Column:
    return wrapped(body, "contents", resource_contents(body, uri, "text/plain"))


def prompt_result(body: Column) -> Column:
    message = F.struct(F.struct(body.alias("text"), F.lit("text").alias("type")).alias("content"), F.lit("user").alias("role"))
    return wrapped(body, "messages", dumped(F.struct(F.array(message).alias("messages"))))


def progress(token: Column, done: Column, total: Column, message: Column) -> Column:
    """A progress notification; the message stands only where there is one."""

    def of(*more: Column) -> Column:
        params = F.struct(*more, done.alias("progress"), token.alias("progressToken"), total.alias("total"))
        return dumped(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit("notifications/progress").alias("method"), params.alias("params")))

    return F.when(F.coalesce(message, F.lit("")) == "", of()).otherwise(of(message.alias("message")))


def changed(registry: Column) -> Column:
    """The notification that a registry has been replaced."""
    return dumped(F.struct(F.lit("2.0").alias("jsonrpc"), F.concat(F.lit("notifications/"), registry, F.lit("/list_changed")).alias("method")))


def sse_frame(json: Column) -> Column:
    return F.concat(F.lit("event: message\ndata: "), json, F.lit("\n\n"))


def log_line(at: Column, text: Column, longest: int = 300) -> Column:
    """A line of the log: epoch milliseconds and the beginning of a text."""
    return F.format_string("[%d] %s", F.unix_millis(at.cast("timestamp")), F.substring(text, 1, longest))


def schema(properties: dict[str, tuple[str, str]], required: Sequence[str]) -> Column:
    """An object's schema: properties are name -> (type, description)."""
    of = F.struct(*[F.struct(F.lit(d).alias("description"), F.lit(t).alias("type")).alias(p) for p, (t, d) in sorted(properties.items())])
    return F.struct(of.alias("properties"), F.array(*map(F.lit, required)).alias("required"), F.lit("object").alias("type"))


def annotations(read_only: bool = False, destructive: bool = False, idempotent: bool = False, open_world: bool = False) -> Column:
    hints = {"destructiveHint": destructive, "idempotentHint": idempotent, "openWorldHint": open_world, "readOnlyHint": read_only}
    return F.struct(*[F.lit(v).alias(k) for k, v in hints.items()])


def tool(name: Column, description: Column, input: Column, output: Column | None = None, hints: Column | None = None) -> Column:
    """A tool's definition; hints and the schema of its result stand only where they are given."""
    fields = [description.alias("description"), input.alias("inputSchema"), name.alias("name")]
    fields = ([hints.alias("annotations")] if hints is not None else []) + fields + ([output.alias("outputSchema")] if output is not None else [])
    return dumped(F.struct(*fields))


def tool_event(id: Column, tool: Column, arguments: Column, token: Column) -> Column:
    """A call as the host gets it; the progress token stands only where the caller gave one."""

    def of(*more: Column) -> Column:
        return dumped(F.struct(arguments.alias("arguments"), id.alias("id"), *more, tool.alias("tool"), F.lit("tool_call").alias("type")))

    return F.when(token.isNull(), of()).otherwise(of(token.alias("progressToken")))


def resource_event(id: Column, uri: Column) -> Column:
    return dumped(F.struct(id.alias("id"), F.lit("resource_read").alias("type"), uri.alias("uri")))


def prompt_event(id: Column, name: Column, arguments: Column) -> Column:
    return dumped(F.struct(arguments.alias("arguments"), id.alias("id"), name.alias("name"), F.lit("prompt_get").alias("type")))


def forwarded(id: Column, method: Column, path: Column, body: Column, content_type: Column, params: Column) -> Column:
    """A request of another route as the host gets it; ``params`` are (key, value) structs."""
    sorted_ = F.map_from_entries(F.array_sort(params))
    return dumped(F.struct(body.alias("body"), content_type.alias("content_type"), id.alias("id"), method.alias("method"), sorted_.alias("params"), path.alias("path")))


def answer(id: Column, body: Column) -> Column:
    """The host's answer to a call."""
    return dumped(F.struct(body.alias("body"), id.alias("id")))


def reply(id: Column, status: int, body: Column) -> Column:
    """The answer to a forwarded request."""
    return dumped(F.struct(body.alias("body"), F.lit("application/json").alias("content_type"), id.alias("id"), F.lit(status).alias("status")))
