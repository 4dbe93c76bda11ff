"""Admission predicates of a request: origin, bearer token, session, accepted output, route and method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that any scheme may carry, schemes that any host may, and protocol words.
LOCAL_HOSTS = ("://localhost", "://127.0.0.1", "://[::1]")
EDITOR_SCHEMES = ("vscode-webview://", "vscode-file://")
EVENT_STREAM = "text/event-stream"
METHODS = (
    "initialize", "notifications/initialized", "ping", "tools/list", "tools/call",
    "resources/list", "resources/read", "prompts/list", "prompts/get",
)


def allowed_origin(origin: Column) -> Column:
    """True for no origin, a local host anywhere after the scheme, or an editor's scheme."""
    o = F.coalesce(origin, F.lit(""))
    out = o == ""
    for host in LOCAL_HOSTS:
        out = out | o.contains(host)
    for scheme in EDITOR_SCHEMES:
        out = out | o.startswith(scheme)
    return out


def authorized(header: Column, token: str) -> Column:
    """True without a token to ask for; else the header is ``Bearer`` and exactly that token."""
    if not token:
        return F.lit(True)
    return F.coalesce(header, F.lit("")) == F.lit(f"Bearer {token}")


def accepts_events(accept: Column) -> Column:
    return F.coalesce(accept, F.lit("")).contains(EVENT_STREAM)


def stream_opening(accept: Column) -> Column:
    """What a request to listen gets: 200, or 406 where it doesn't take event streams."""
    return F.when(accepts_events(accept), 200).otherwise(406)


def streams_answer(accept: Column, progress_token: Column) -> Column:
    """An answer is streamed to a client that takes event streams and gave a progress token."""
    return accepts_events(accept) & progress_token.isNotNull()


def route(verb: Column, path: Column) -> Column:
    """The first route that matches, by verb and whole path; null where none does."""
    get = verb.isin("GET", "HEAD")
    return (
        F.when(get & path.rlike(r"^/health$"), "health").when(get & path.rlike(r"^/mcp$"), "events").when((verb == "POST") & path.rlike(r"^/mcp$"), "rpc")
        .when((verb == "DELETE") & path.rlike(r"^/mcp$"), "close").when(verb == "OPTIONS", "preflight")
        .when(get | verb.isin("POST", "PUT", "DELETE", "PATCH"), "forward")
    )


def outcome(method: Column, has_id: Column) -> Column:
    """What becomes of a message: a known method is answered, anything else without id is a notification."""
    return F.when(method.isin(*METHODS), method).when(~has_id, F.lit("notification")).otherwise(F.lit("method_not_found"))


def rated(verb: Column) -> Column:
    """Whether requests of this verb take from the bucket."""
    return verb == "POST"


def guarded(verb: Column, local: Column, known: Column) -> Column:
    """What refuses a request before its rate is looked at: 403 for its origin, then 401 for its token; null where nothing does. A session
    is closed without either."""
    return F.when(verb == "DELETE", F.lit(None).cast("int")).when(~local, 403).when(~known, 401)


def missing(value: Column) -> Column:
    """A required parameter that is absent or empty."""
    return F.coalesce(value, F.lit("")) == ""


def required(value: Column, parameter: str) -> Column:
    """The error of a required parameter that is missing, else null."""
    return F.when(missing(value), F.lit(f"Missing '{parameter}' in params"))


def handled(name: Column, handlers: dict[str, str], kind: str) -> Column:
    """The handler of a name, by first match; else what an unknown one is answered."""
    out = F.concat(F.lit(f"Unknown {kind}: "), F.coalesce(name, F.lit("")))
    for known, handler in reversed(handlers.items()):
        out = F.when(name == known, F.lit(handler)).otherwise(out)
    return out
