"""Deep pages and positions against a full sort."""

import pytest
from pyspark.sql import functions as F

from tidegate.operators import paging

ROWS = 120_000


@pytest.fixture(scope="module")
def rows(spark):
    """Many columns, an order of three with nulls and very many ties in the first."""
    i = F.col("id")
    return spark.range(ROWS).select(F.when(i % 7 != 0, i % 11).alias("a"), F.concat(F.lit("s"), (i * 7919 % 1000).cast("string")).alias("b"), "id", (i % 5).alias("x"), F.repeat(F.lit("wide"), 20).alias("y"))


ORDER = ["a", "b", "id"]


def test_pages_at_every_depth(rows):
    sorted_ids = [r.id for r in rows.select(*ORDER).orderBy(*ORDER).collect()]
    for offset in (10_000, 10_001, ROWS // 2, ROWS - 20, ROWS):
        got = paging.page(rows, ORDER, offset).collect()
        assert [r.id for r in got] == sorted_ids[offset : offset + 50]
        assert {r.next_cursor for r in got} <= {str(offset + 50) if offset + 50 < ROWS else None}


def test_both_ways_agree(rows):
    some = rows.where("id < 3000")
    for offset in (101, 1_370, 2_980, 3_000):
        a, b = (paging.page(some, ORDER, offset, near=near).collect() for near in (10_000, 100))
        assert a == b


def test_positions_whatever_is_read(rows):
    sorted_ids = [r.id for r in rows.select(*ORDER).orderBy(*ORDER).collect()]
    placed = paging.positions(rows, ORDER)
    assert [r.id for r in placed.select("id", "pos").orderBy("pos").collect()] == sorted_ids
    assert placed.agg(F.sum("pos")).first()[0] == ROWS * (ROWS - 1) // 2


def test_one_key_has_all_rows(spark):
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert paging.page(same, ["k"], 400, near=10).count() == 50
    assert sorted(r.pos for r in paging.positions(same, ["k"]).collect()) == list(range(500))


def test_empty(spark):
    assert paging.page(spark.range(0), ["id"], 20_000).collect() == []
    assert paging.positions(spark.range(0), ["id"]).collect() == []
