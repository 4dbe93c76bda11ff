import numpy as np

from tidegate.llm import queries, vectors
from tidegate.llm.components import components


def brute(ids, vs, threshold=0.95):
    ok = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vs]
    n = len(ids)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vs[i]) == len(vs[j]):
                a, b = np.float64(vs[i]), np.float64(vs[j])
                link[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == label:
            break
        label = new
    out = []
    for i in range(n):
        members = [ids[k] for k in range(n) if label[k] == label[i] and ids[k] is not None]
        c = min(members, default=None)
        out.append((ids[i] if ids[i] is not None else -1, int(link[i].sum()), c, ids[i] == c))
    return sorted(out, key=repr)


def got(df, **p):
    return sorted(((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, **p).collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vs = []
    for _ in range(12):
        base = rng.standard_normal(16)
        vs += [(base + rng.standard_normal(16) * 0.12).astype(np.float32).tolist() for _ in range(rng.integers(1, 9))]
    vs += [vs[0], vs[0], None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1.0] * 16, [-1.0] * 16]
    ids = [i * 3 % 97 for i in range(len(vs))]
    ids[5] = None
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vs, strict=True)], "vec_id long, embedding array<float>, n_links int, cid string")
    want = brute(ids, [None if v is None else v for v in vs])
    assert got(df) == want
    assert got(df, window=4, passes=12, block=3) == want


def test_wide_group_and_recall(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(64)
    vs = [base + rng.standard_normal(64) * 0.1 for _ in range(300)]
    for _ in range(200):
        b = rng.standard_normal(64)
        vs += [b, b + rng.standard_normal(64) * 0.17]
    ids = list(range(len(vs)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vs, strict=True)], "vec_id long, embedding array<double>")
    want, have = brute(ids, vs), got(df, window=16, passes=vectors.passes_for(len(vs), 16), block=64)
    missed = sum(abs(a[1] - b[1]) for a, b in zip(sorted(want), sorted(have), strict=True))
    assert missed <= 0.02 * sum(a[1] for a in want)
    assert all(b[1] <= a[1] for a, b in zip(sorted(want), sorted(have), strict=True))


def test_dense_region(spark):
    rng = np.random.default_rng(11)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 128)))
    dense = np.sqrt(0.9) * unit(1) + np.sqrt(0.1) * unit(6000)  # near 0.9 to each other
    pairs = dense[:100] + np.sqrt(2 * 0.04) * unit(100)
    vs = np.concatenate([dense, pairs, unit(2000)])
    x = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    have = {r.vec_id: r.n_links for r in vectors.near_vectors(df, window=16).collect()}
    assert want.sum() >= 150
    assert all(have[i] <= n for i, n in enumerate(want)) and sum(have.values()) >= 0.99 * want.sum()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    have = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op6_near_vectors"](spark, sf).collect()), key=repr)
    assert have == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_query_on_a_table_with_links(spark, tmp_path):
    """The given embeddings hold no link; this table does: copies, chains, a crowd, and vectors that link with nothing."""
    rng = np.random.default_rng(21)
    vs = []
    for _ in range(25):
        b = rng.standard_normal(64)
        vs += [(b + rng.standard_normal(64) * 0.2 * k / 3).astype(np.float32).tolist() for k in range(rng.integers(1, 6))]
    step = rng.standard_normal(64)
    vs += [(b := rng.standard_normal(64)).astype(np.float32).tolist()] + [(b := b + 0.045 * np.linalg.norm(b) * step / 2).astype(np.float32).tolist() for _ in range(12)]
    vs += [vs[0]] * 40 + [None, [0.0] * 64, [float("nan")] * 64] + [rng.standard_normal(64).astype(np.float32).tolist() for _ in range(120)]
    rows = [(i * 13 % 1009, v, i % 5) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    have = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op6_near_vectors"](spark, str(tmp_path)).collect()), key=repr)
    want = brute([i for i, _, _ in rows], [v for _, v, _ in rows])
    assert have == want and sum(r[1] > 0 for r in want) > 80 and sum(not r[3] for r in want) > 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (5, 3), (None, 1)]
    out = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
