import collections
import re

import numpy as np
import pytest

from tidegate.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == [50.0, 100.0, 150.0]
    assert mixing.targets([("a", 1), ("b", 300)]) == [3.0, 298.0]
    # a stops at 3; of the rest c and d, by 3 and 1, would leave c above 30: it stops there, and b and d share by 2 and 1
    assert mixing.targets([("a", 1), ("b", 500), ("c", 10), ("d", 489)]) == pytest.approx([3.0, 967 * 2 / 3, 30.0, 967 / 3])
    assert mixing.targets([("a", 0), ("b", 0)]) == [0.0, 0.0] and mixing.targets([]) == []


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 90, 40), rng.random(40)
    total = np.zeros(40)
    for _ in range(4000):
        q, at = mixing.pivot(p, size, rng.random(41))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert all(v in (0.0, 1.0) for i, v in enumerate(q) if i != at)
        total += q
    assert abs(total / 4000 - p).max() < 0.05


def shares(sizes, most=3):
    """Targets by filling up: the level at which what the sources take, each at most its limit, adds up to all words."""
    weight = [1 + i % 3 for i in range(len(sizes))]
    lo, hi = 0.0, float(sum(sizes)) + 1
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(level * w, most * n) for w, n in zip(weight, sizes, strict=True)) < sum(sizes) else (lo, level)
    return [min(hi * w, most * n) for w, n in zip(weight, sizes, strict=True)]


def check(rows, most=3):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    goal = shares([sum(r.size for r in by[s]) for s in order])
    for s, t in zip(order, goal, strict=True):
        assert all(abs(r.target - t) < 1e-6 and r.source_size == sum(x.size for x in by[s]) for r in by[s])
        assert all(r.taken <= most * r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= max([r.size for r in by[s]]) + 1e-6


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1000
    check(rows)
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == words and all(r.taken == r.copies * r.size for r in rows)
    again = queries.QUERIES["op9_mixing"](spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_tree_and_odd_rows(spark):
    rows = [(i, "w " * (1 + i % 17), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    rows += [(None, "x y", None), (None, "x y", None), (7, None, None), (8, "", "hot"), (9, None, "empty"), (1, "w w ", "hot"), (1, "w w ", "hot")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size long, target string")
    out = mixing.mix(df, chunk_rows=8, fan_in=4).collect()
    assert len(out) == len(rows)
    check(out)
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(df.limit(0)).collect() == []
    kept = mixing.mixed_rows(df, chunk_rows=8, fan_in=4)
    assert kept.columns == df.columns and kept.count() > 0
    assert abs(kept.count() - 1500) < 200
