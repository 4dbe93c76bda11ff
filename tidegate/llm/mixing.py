"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document of that source is to be copied ratio = target / source
size times on average. The whole part of the ratio is certain. The fractions are rounded in pairs: words
move from one document's expectation to the other's, in a direction drawn so that both expectations
hold, until one of the two is 0 or 1. The expected words of a source never change, so what it takes ends
within one document of its target. Chunks of a source are rounded apart from each other and leave one
undecided document each; those meet in a reduction tree, level by level, until a source has one left,
which is drawn. Draws are seeded by place in that tree and rows are put in order first: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._scratch import written
from tidegate.llm._text import WORD

CHUNK_ROWS, FAN_IN, MOST_COPIES, WEIGHTS = 512, 256, 3.0, (1.0, 2.0, 3.0)


def words_in(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> list[float]:
    """Targets of the sources in the given order; weights repeat along it. A target stops at ``most`` times
    the source's size and what it leaves goes to the others by weight, until none is above."""
    total = float(sum(n for _, n in sizes))
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        whole = sum(share[i] for i in free)
        full = {i for i in free if left * share[i] / whole > most * sizes[i][1]}
        if not full:
            for i in free:
                out[i] = left * share[i] / whole
            break
        for i in full:
            out[i] = most * sizes[i][1]
        left -= sum(out[i] for i in full)
        free -= full
    return out


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds the fractions but one: (fractions, place of the undecided one or -1)."""
    p, at = p.astype(float).copy(), -1
    for i in range(len(p)):
        if size[i] <= 0 or p[i] <= 0 or p[i] >= 1:
            continue
        if at < 0:
            at = i
            continue
        s, t = float(size[at]), float(size[i])
        up_at, up_i = (1 - p[at]) * s, p[i] * t  # words that can move from i to at
        down_at, down_i = p[at] * s, (1 - p[i]) * t
        up, down = min(up_at, up_i), min(down_at, down_i)
        if draws[i] * (up + down) < down:
            at_done, i_done = up_at <= up_i, up_i <= up_at
            p[at] = 1.0 if at_done else p[at] + up / s
            p[i] = 0.0 if i_done else p[i] - up / t
        else:
            at_done, i_done = down_at <= down_i, down_i <= down_at
            p[at] = 0.0 if at_done else p[at] - down / s
            p[i] = 1.0 if i_done else p[i] + down / t
        if at_done:
            at = -1 if i_done else i
    return p, at


def _rounded(seed: int, level: int, order: list[str], last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        where = table.column("__group")[0].as_py()
        draws = np.random.default_rng([seed, level, where & 0xFFFFFFFF, (where >> 32) & 0xFFFFFFFF]).random(len(table) + 1)
        p, at = pivot(table.column("__p").to_numpy(), table.column("size").to_numpy(), draws)
        if last and at >= 0:
            p[at], at = float(draws[-1] < p[at]), -1
        open_ = np.zeros(len(table), bool)
        if at >= 0:
            open_[at] = True
        for name, values in (("__p", pa.array(p)), ("__open", pa.array(open_))):
            table = table.set_column(table.schema.get_field_index(name), name, values)
        return table

    return run


def mix(df: DataFrame, id: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: int = 17, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, text: str = "text") -> DataFrame:
    """One row per row: id, source, size, source_size, target, copies, taken (copies * size).

    ``size`` defaults to the words of ``text``; null texts and empty ones have size 0 and are never
    taken. A null source is a source of its own, last in order. Ids may be null or repeat: every row is
    decided on its own. Sources are few: one row for each comes to the driver. Other columns are left
    out; an empty table gives an empty table.
    """
    return _decided(_sized(df, id, source, size, text), id, weights, most, seed, chunk_rows, fan_in).drop("__tie")


def _sized(df: DataFrame, id: str, source: str, size: Column | None, text: str) -> DataFrame:
    return df.select(F.col(id), F.col(source).alias("source"), (words_in(text) if size is None else size).alias("size"), F.xxhash64(F.col(id), F.col(text)).alias("__tie"))


def _decided(rows: DataFrame, id: str, weights: Sequence[float], most: float, seed: int, chunk_rows: int, fan_in: int) -> DataFrame:
    spark = rows.sparkSession
    rows = written(rows, "sizes")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    goal = targets([(r.source, r.n) for r in found], weights, most)
    plan = spark.createDataFrame(
        [(r.source, r.n, float(t), min(most, t / r.n) if r.n else 0.0, -(-r.rows // chunk_rows)) for r, t in zip(found, goal, strict=True)],
        "__source string, source_size long, target double, __ratio double, __chunks long",
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("__base", F.floor("__ratio").cast("long")).withColumn("__p", F.col("__ratio") - F.col("__base"))
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64(F.lit(seed), "__tie", "size"), F.col("__chunks"))).withColumn("__open", F.lit(False)).drop("__ratio", "__chunks")
    rows = rows.withColumn("__group", F.xxhash64("source", "__chunk"))
    n = max([1, *(-(-r.rows // chunk_rows) for r in found)])
    first = rows.groupBy("source", "__chunk").applyInArrow(_rounded(seed, 0, ["__tie", "size"], n == 1), rows.schema)
    first = written(first, "mixed")
    settled = first.where(~F.col("__open"))
    waiting = first.where("__open").select("source", "__chunk", "size", "__p", "__open", F.col("__chunk").alias("__first"))
    decided, level = None, 0
    while n > 1:
        n, level = -(-n // fan_in), level + 1
        waiting = waiting.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in).cast("long")).withColumn("__group", F.xxhash64("source", "__chunk"))
        done = waiting.groupBy("source", "__chunk").applyInArrow(_rounded(seed, level, ["__first"], n == 1), waiting.schema)
        done = written(done, "mixed")
        now = done.where(~F.col("__open")).select(F.col("source").alias("__source"), "__first", F.col("__p").alias("__final"))
        decided = now if decided is None else decided.unionByName(now)
        waiting = done.where("__open").drop("__group")
    out = settled
    if decided is not None:
        late = first.where("__open").join(decided, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__chunk") == F.col("__first")))
        out = settled.unionByName(late.withColumn("__p", F.col("__final")).select(settled.columns))
    copies = F.when(F.col("size") > 0, F.col("__base") + F.round("__p").cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(id, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "__tie")


def mixed_rows(df: DataFrame, id: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: int = 17, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, text: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it. Rows equal in id, text and source share a decision."""
    units = _sized(df, id, source, size, text).distinct()
    taken = _decided(units, id, weights, most, seed, chunk_rows, fan_in).where("copies > 0")
    taken = taken.select(F.col(id).alias("__id"), F.col("source").alias("__source"), F.col("__tie").alias("__of"), "copies")
    own = df.withColumn("__tie", F.xxhash64(F.col(id), F.col(text)))
    out = own.join(taken, (F.col("__tie") == F.col("__of")) & F.col(id).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__source")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(df.columns)
