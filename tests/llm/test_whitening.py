import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import queries, whitening


def brute(vectors, k=8):
    """Covariance formed whole, in numpy."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, (((n * x - s).astype(object)) ** 2).sum(axis=1), e, v, c


def check(rows, table, k=8, digits=1e-7):
    """``table``: (id, vector) of the rows that remain."""
    ids = [i for i, _ in table]
    n, deviation, e, v, c = brute([x for _, x in table])
    assert len(rows) == len(table) * k and {r.n for r in rows} == {n}
    got = {(r.vec_id, r.component): r for r in rows}
    for j in range(k):
        sign = np.sign(sum(got[i, j + 1].whitened * w for i, w in zip(ids, c @ v[:, j], strict=True)))
        want = sign * (c @ v[:, j]) / math.sqrt(e[j])
        assert np.abs(np.array([got[i, j + 1].whitened for i in ids]) - want).max() < digits
        assert abs(got[ids[0], j + 1].explained / (e[j] / e.sum()) - 1) < 1e-9
    assert all(got[i, 1].deviation == d for i, d in zip(ids, deviation, strict=True))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_whitening"](spark, path).collect(), table)


@pytest.fixture(scope="module")
def clear(spark):
    """400 dimensions, with a few directions that stand out."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)) * np.array([90, 70, 50, 40, 30, 24, 20, 16]) @ np.linalg.qr(rng.standard_normal((400, 8)))[0].T + rng.standard_normal((600, 400)) * 0.05
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)


def test_narrow_blocks_suffice_where_components_stand_out(spark, clear):
    rows, df = clear
    fit = whitening.fitted(df)
    assert fit.vectors.shape == (400, 8) and fit.residual <= whitening.TOLERANCE and fit.passes <= 8
    check(whitening.whitened(df, fit=fit).collect(), rows)


def test_close_eigenvalues_widen_the_block(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(rng.standard_normal((3000, 120)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    fit = whitening.fitted(df)
    assert fit.passes < 12
    check(whitening.whitened(df, fit=fit).collect(), rows, digits=1e-6)


def test_sums_go_through_a_tree(spark, clear, monkeypatch):
    rows, df = clear
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    check(whitening.whitened(df).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(v)) for v in rng.standard_normal(3)]) for i in range(20)] + [(3, [0.5, 0.25, -1.0])] * 2 + [(None, [1.0, 2.0, 3.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 0.0]), (53, [0.0, float("inf"), 0.0]), (54, []), (55, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id long, embedding array<float>, component int, n string")
    out = whitening.whitened(df).collect()
    assert len(out) == 3 * len(good) and {r.component for r in out} == {1, 2, 3} and {r.n for r in out} == {len(good)}
    assert sum(r.vec_id is None for r in out) == 3 and not {r.vec_id for r in out} & set(range(50, 56))
    assert out[0].identity_error < 1e-9 and abs(sum(r.explained for r in out[:3]) - 1) < 1e-9
    empty = whitening.whitened(df.where(F.lit(False)))
    assert empty.collect() == [] and empty.columns == whitening.whitened(df).columns
    # without variance nothing can be whitened
    assert whitening.whitened(df.where("vec_id = 7")).collect() == []
    flat = spark.createDataFrame([(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}


def test_deviations_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [float(i) * 1e9, 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitened(df).collect()}
    x = [int(1024 * i * 1e9) + 100_000 for i in range(100)]
    for i in range(100):
        d = (100 * x[i] - sum(x)) ** 2
        assert got[i] == (d if d < 1 << 63 else None)
    assert None in got.values()
