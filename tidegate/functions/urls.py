"""Query strings and percent-encoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = r"(?:%[0-9A-Fa-f]{2})+|(?:%u[0-9A-Fa-f]{4})+"
_HIGH, _LOW = "^[dD][89abAB]", "^[dD][c-fC-F]"


def _units(run: Column) -> Column:
    """Hexadecimal UTF-16 units, each surrogate without its partner replaced by U+FFFD."""
    units = F.regexp_extract_all(run, F.lit("%u([0-9A-Fa-f]{4})"), F.lit(1))

    def whole(u: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get(units, i - 1)), F.get(units, i + 1)
        lone = u.rlike(_HIGH) & ~F.coalesce(after.rlike(_LOW), F.lit(False)) | u.rlike(_LOW) & ~F.coalesce(before.rlike(_HIGH), F.lit(False))
        return F.when(lone, F.lit("FFFD")).otherwise(u)

    return F.array_join(F.transform(units, whole), "")


def url_decode(s: Column) -> Column:
    """%XX runs as UTF-8, %uXXXX runs as UTF-16, + as a space; what is malformed stays, but that a surrogate without its partner
    becomes U+FFFD."""

    def one(m: Column) -> Column:
        wide = F.decode(F.unhex(_units(m)), "UTF-16BE")
        return F.when(m.startswith("%u"), wide).otherwise(F.coalesce(F.try_url_decode(m), m))

    found = F.transform(F.regexp_extract_all(s, F.lit(_RUN), F.lit(0)), one)
    gaps = F.split(F.translate(s, "+", " "), _RUN)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(found, i), F.lit("")))), "")


def query_string(url: Column) -> Column:
    """What follows the first ? up to a #, empty if nothing does."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def query_params(query: Column) -> Column:
    """Parameters as an array of (key, value): pairs that repeat whole are dropped, empty keys too, both sides are
    decoded, and of a key given twice the last value holds."""
    parts = F.array_distinct(F.transform(F.split(query, "&"), F.trim))
    pair = lambda p: F.struct(url_decode(F.substring_index(p, "=", 1)).alias("key"), url_decode(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(""))).alias("value"))
    pairs = F.transform(F.filter(parts, lambda p: F.substring_index(p, "=", 1) != ""), pair)
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
