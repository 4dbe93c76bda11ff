import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from oracle import same_rows
from tidegate.llm import _sorted, _text, queries, superkmers

W = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows, window):
    least, out = {}, []
    for i, t in rows:
        w = W.findall(t or "")
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                least[k] = min(least.get(k, i), i)
    for i, t in rows:
        w, gone = W.findall(t or ""), set()
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "é", "𝒳", "x\x1c", "tion"]) + str(rng.randint(0, 30))
    shared = [[word() for _ in range(rng.randint(8, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
        rows.append((i * 7 % 131, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1]), (900, None), (901, ""), (902, " \n"), (903, rows[8][1]), (904, "a b " * 300), (905, "a b " * 200)]
    return rows + [(1000 + i, " ".join(shared[0] + shared[1])) for i in range(30)]


@pytest.mark.parametrize("window,k,most", [(10, 3, 200), (10, 3, 4), (7, 7, 0), (50, 8, 3)])
def test_against_brute_force(spark, window, k, most):
    rows = corpus(window + most)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, id string")
    got = superkmers.without_repeats(df, window=window, k=k, most_runs=most).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


@pytest.mark.parametrize("held", [50_000, 20, 1])
@pytest.mark.parametrize("parts", [1, 5, 60])
def test_windows_sorted_over_many_tasks(spark, monkeypatch, parts, held):
    """One key has a third of all rows, so that it runs over several tasks, and most tasks hold a key or two."""
    rng = random.Random(parts)
    rows = [(b"%016d" % (7 if rng.random() < 0.3 else rng.randint(0, 400)), b"s%d" % i, i % 5, rng.randint(0, 50), rng.randint(50, 90)) for i in range(3000)]
    rows += [(b"only-one-document", b"t%d" % i, 0, 5, 5) for i in range(40)]
    rows = [(k[:16], s, off, lo, hi) for k, s, off, lo, hi in rows]
    docs: dict = {}
    for k, _, _, lo, hi in rows:
        docs.setdefault(k, set()).update((lo, hi))
    want = sorted((s, off, lo, *sorted(docs[k])[:2]) for k, s, off, lo, _ in rows if len(docs[k]) > 1)
    monkeypatch.setattr(_sorted, "HELD_ROWS", held)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = _sorted.shared(spark.createDataFrame(rows, _sorted.WINDOW_DDL)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((bytes(r.sid), r.off, r.lo, r.least, r.second) for r in got) == want


def test_empty(spark):
    assert superkmers.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_runs():
    texts = ["", "a  b\tc\n", " x", "", "\x1cé y ", "last"]
    b = list(_text.blocks(pa.array(texts)))
    assert sum(x.n for x in b) == 6
    x = b[0]
    words = [bytes(x.data[s:e]).decode() for s, e in zip(x.starts, x.ends, strict=True)]
    assert words == [w for t in texts for w in W.findall(t)] and list(np.diff(x.bounds)) == [len(W.findall(t)) for t in texts]
    many = list(_text.blocks(pa.array(texts * 50), size=7))
    assert sum(len(x.starts) for x in many) == 50 * len(words)
    h = {}
    for x in many:
        for s, e, v in zip(x.starts, x.ends, x.hashes(), strict=True):
            assert h.setdefault(bytes(x.data[s:e]), v) == v
    assert len(set(h.values())) == len(h)
    one = next(_text.blocks(pa.array([" ".join(str(i * i % 37) for i in range(300)), "few words", " ".join("abc" * 40)])))
    text, at, n, mini = superkmers.runs(one, 20, 4)
    assert n.sum() == (300 - 19) + (120 - 19 if len(W.findall(" ".join("abc" * 40))) == 120 else 0)


def test_oracle(spark):
    same_rows(spark, SF, queries.QUERIES["op2_superkmers"], queries.ORACLES["op2_superkmers"])
