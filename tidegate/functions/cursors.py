"""Cursors of lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_cursor(cursor: Column) -> Column:
    """The leading integer of a cursor as an offset; 0 where there is none or it doesn't fit; never negative."""
    return F.greatest(F.coalesce(F.regexp_extract(cursor, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0)), F.lit(0))
