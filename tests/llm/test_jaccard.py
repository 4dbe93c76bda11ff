import random
import re

import pytest

from tidegate.llm import jaccard, queries

W = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = W.findall("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    label = list(range(len(rows)))
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            if den * len(s & sets[j]) >= num * len(s | sets[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, edits):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "b", "The", "é", "tion", "of"]) + rng.choice(["", str(rng.randint(0, 200))])
    bases = [[word() for _ in range(rng.choice([1, 2, 4, 30, 60, 200]))] for _ in range(12)]
    passage = [word() for _ in range(15)]
    rows = []
    for i in range(260):
        w = list(rng.choice(bases[:6] if i % 2 else bases))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        rows.append((i * 7 % 401, rng.choice([" ", "\n"]).join(w + (passage if i % 3 == 0 else []))))
    return rows + [rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, "lonely text"), (500, None), (501, ""), (502, " "), (503, rows[4][1].upper()), (504, "b"), (505, "B")]


@pytest.mark.parametrize("n,threshold,edits", [(3, (90, 100), 4), (5, (80, 100), 6), (2, (50, 100), 20)])
def test_against_brute_force(spark, monkeypatch, n, threshold, edits):
    rows = corpus(n, edits)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, c string")
    got = jaccard.similar(df, n=n, threshold=threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, *threshold)


def test_few_neighbours_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NEIGHBOURS", 1)
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 5)
    rows = corpus(9, 5)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), n=3, threshold=(80, 100)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 3, 80, 100)


def test_empty(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op4_jaccard"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 3, 90, 100)
