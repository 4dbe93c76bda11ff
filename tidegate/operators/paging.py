"""Cursor pagination and positions in a total order.

No task and no driver sees all rows of a deep page or of a numbering. Positions are numbered in ranges that are sorted and written
once. A deep page alone takes no such table: a bounded sample gives boundaries that cut the order into ranges, every pass over
the rows reads the same boundaries from a table of one row, and one count a range tells how many rows stand before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.cursors import parsed_cursor
from tidegate.operators import scan

__all__ = ["PAGE_SIZE", "cursor_chain", "page", "parsed_cursor", "positions", "ranges"]

PAGE_SIZE = 50
#: Rows before a page up to which top-k finds it in one pass; Spark's own offset gathers them. Both ways give the same rows.
NEAR = 10_000
#: Ranges that a deep page's search cuts the order into, one pass after the other, and rows of the sample for each boundary.
RANGES, SAMPLE_FOR_EACH = 128, 30


@dataclass
class Ranges:
    """Ranges of an order and the rows in each: range k holds keys from cuts[k - 1], itself included, to cuts[k]."""

    key: Column
    kinds: T.StructType
    cuts: list[tuple]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def before(self, k: int) -> int:
        return sum(self.counts[:k])

    def within(self, first: int, last: int) -> Column:
        """Whether a row is in the ranges first .. last."""
        literal = lambda r: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, self.kinds, strict=True)])
        out = F.lit(True)
        if first:
            out = out & (self.key >= literal(self.cuts[first - 1]))
        if last < len(self.counts) - 1:
            out = out & (self.key < literal(self.cuts[last]))
        return out


def ranges(df: DataFrame, order: Sequence[str], n: int = RANGES) -> Ranges:
    """At most n ranges of about equal size, n never growing with the rows. The driver gets a sample of SAMPLE_FOR_EACH keys a
    range and a count of each."""
    narrow = df.select(*order)
    key = F.struct(*[F.col(c) for c in order])
    total = narrow.count()
    found = narrow.sample(min(1.0, SAMPLE_FOR_EACH * n / max(1, total)), seed=3).collect()
    found.sort(key=lambda r: tuple((v is not None, v != v, v) if v is not None else (False, False, 0) for v in r))
    cuts = list(dict.fromkeys(tuple(found[len(found) * i // n]) for i in range(1, n))) if found else []
    if not cuts:
        return Ranges(key, narrow.schema, [], [total])
    # the boundaries travel as data, not as expressions of the plan
    rows = df.sparkSession.createDataFrame(cuts, narrow.schema)
    bounds = F.broadcast(rows.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__bounds")))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        beyond = key >= F.get(F.col("__bounds"), mid)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(beyond, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(beyond, s["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    of = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halved, lambda s: s["lo"])
    counted = {r.k: r.n for r in narrow.crossJoin(bounds).groupBy(of.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return Ranges(key, narrow.schema, cuts, [counted.get(k, 0) for k in range(len(cuts) + 1)])


def page(df: DataFrame, order: Sequence[str], offset: int, size: int = PAGE_SIZE, near: int | None = None) -> DataFrame:
    """The rows of a page, in order, with next_cursor: where the next page begins, null on the last.

    A page that lies deep is looked for by counts: the ranges that hold it are read again, in finer ranges, until few rows
    stand before it there.
    """
    end, left, rows, near = offset + size, offset, df, max(NEAR if near is None else near, size)
    if offset <= near:
        total = F.col("__total")
        rows = df.orderBy(*order).offset(offset).limit(size).crossJoin(df.agg(F.count(F.lit(1)).alias("__total")))
        return rows.withColumn("next_cursor", F.when(total > end, F.lit(str(end)))).drop("__total")
    known: int | None = None
    while left > near:
        cut = ranges(rows, order)
        known = cut.total if known is None else known
        if left >= cut.total:
            rows, left = rows.limit(0), 0
            break
        first = max(k for k in range(len(cut.counts)) if cut.before(k) <= left)
        last = max(k for k in range(len(cut.counts)) if cut.before(k) < left + size)
        if cut.counts[first] == cut.total:  # one key has all rows: nothing parts them
            break
        rows, left = rows.where(cut.within(first, max(first, last))), left - cut.before(first)
    rows = rows.orderBy(*order).offset(left).limit(size)
    return rows.withColumn("next_cursor", F.lit(str(end) if known > end else None).cast("string"))


def positions(df: DataFrame, order: Sequence[str], name: str = "pos", range_rows: int | None = None) -> DataFrame:
    """Rows with their place from 0 in a total order: sorted once into ranges, each shifted by the rows before it. Rows that are
    equal in ``order`` follow each other in any order."""
    table = scan.placed(df, order, range_rows)
    out = table.join(scan.before(table), scan.RANGE).withColumn(name, F.col(scan.AT) + F.col("__before"))
    return out.select(*df.columns, name)


def cursor_chain(df: DataFrame, order: Sequence[str], key: str, size: int = PAGE_SIZE, range_rows: int | None = None) -> DataFrame:
    """One row per page: page (from 0), n_items, first_key, last_key, next_cursor, null on the last."""
    placed = positions(df, order, "pos", range_rows)
    paged = placed.withColumn("page", F.floor(F.col("pos") / size).cast("long"))
    pages = paged.groupBy("page").agg(F.count(F.lit(1)).alias("n_items"), F.min_by(key, "pos").alias("first_key"), F.max_by(key, "pos").alias("last_key"))
    end, total = (F.col("page") + 1) * size, df.agg(F.count(F.lit(1)).alias("__total"))
    return pages.crossJoin(total).select("page", "n_items", "first_key", "last_key", F.when(end < F.col("__total"), end.cast("string")).alias("next_cursor"))
