import random
import re

import pytest

from tidegate.llm import _sorted, queries, suffixes

W = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows, window):
    """Words of each document that a window covers which another document has."""
    where, covered = {}, {}
    for i, t in rows:
        w = W.findall(t or "")
        for p in range(len(w) - window + 1):
            if i is not None:
                where.setdefault(tuple(w[p : p + window]), set()).add(i)
    for i, t in rows:
        w = W.findall(t or "")
        for p in range(len(w) - window + 1):
            if i is not None and len(where[tuple(w[p : p + window])]) > 1:
                covered.setdefault(i, set()).update(range(p, p + window))
    return covered


def compare(rows, got, window, least=1.0):
    want, have = brute(rows, window), {}
    for r in got:
        assert r.other_id != r.doc_id and r.n_words >= window
        have.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert all(have[i] <= want.get(i, set()) for i in have)
    assert sum(map(len, have.values())) >= least * sum(map(len, want.values()))


def others(rows, got, window):
    """The least other document that has one of a passage's windows."""
    texts, where = {}, {}
    for i, t in rows:
        if i is not None:
            w = W.findall(t or "")
            texts.setdefault(i, []).append(w)
            for p in range(len(w) - window + 1):
                where.setdefault(tuple(w[p : p + window]), set()).add(i)
    for r in got:
        found = [min(where[tuple(w[p : p + window])] - {r.doc_id}, default=1 << 60) for w in texts[r.doc_id] for p in range(r.start_word, min(r.start_word + r.n_words, len(w)) - window + 1)]
        assert r.other_id in found and (len(texts[r.doc_id]) > 1 or r.other_id == min(found))


at_sizes: dict[str, list] = {}


@pytest.mark.parametrize("size", [2000, 20, 1])
def test_one_result_at_every_size(spark, monkeypatch, size):
    """Whole rows are the same whether a start's suffixes are sorted together or over all tasks, and whether rows of a key are held."""
    rng = random.Random(9)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    passage, line = [f"p{i}" for i in range(70)], [f"l{i}" for i in range(52)]
    rows = []
    for i in range(60):
        # all have a passage, some also its surroundings, so that some seeds are rare and others are hot
        ahead = passage[: 70 if i % 18 == 0 else 55]
        rows.append((i * 5 % 61, " ".join(own(20) + ahead + own(12) + (line if i % 3 else []) + own(15))))
    rows.append((70, rows[4][1]))
    monkeypatch.setattr(suffixes, "GROUP_ROWS", size)
    monkeypatch.setattr(_sorted, "HELD_ROWS", 7 if size == 1 else 50_000)
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    compare(rows, got, 50)
    others(rows, got, 50)
    # document 70 is a copy, so it and its original are one passage each
    assert len(got) == 60 + 40
    assert at_sizes.setdefault("rows", sorted(map(tuple, got))) == sorted(map(tuple, got))


@pytest.mark.parametrize("window,k", [(10, 3), (20, 8), (50, 8)])
def test_against_brute_force(spark, window, k):
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "the", "é", "x\x1c", "of"]) + str(rng.randint(0, 60))
    passages = [[word() for _ in range(rng.randint(window - 2, 2 * window))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randint(1, 40))]
        rows.append((i * 7 % 131, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [rows[3], (None, rows[4][1]), (900, None), (901, ""), (902, rows[5][1]), (903, "a b " * 300), (904, "a b " * 200), (905, "z z z " * 99)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, at int, id string")
    got = suffixes.repeated_passages(df, window=window, k=k).collect()
    compare(rows, got, window)
    others(rows, got, window)


def test_hot_start_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 20)
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{rng.random()}" for _ in range(30)] + passage + [f"b{rng.random()}" for _ in range(30)])) for i in range(150)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(rows, got, 50)
    assert {(r.start_word, r.n_words) for r in got} == {(30, 60)} and len(got) == 150


def test_empty(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(rows, queries.QUERIES["op7_suffixes"](spark, SF).collect(), 50)


def test_two_share_more_than_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 20)
    rng = random.Random(2)
    line, own = [f"l{i}" for i in range(30)], lambda n: [f"o{rng.random()}" for _ in range(n)]
    rows = []
    for i in range(0, 120, 2):  # pairs share the 25 words after the line too
        more = own(25)
        rows += [(j, " ".join(own(40) + line + more + own(40))) for j in (i, i + 1)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(rows, got, 50)
    assert len(got) == 120 and all(r.other_id == r.doc_id ^ 1 and (r.start_word, r.n_words) == (40, 55) for r in got)


def test_partner_between_many_of_the_same_start(spark):
    rng = random.Random(3)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    texts = []
    for k in range(3):
        passage = [f"p{k}x{i}" for i in range(53)]
        # many share 49 words up to one end, so that the two that share all are neighbours in neither order
        for part in [passage] * 2 + [passage[4:]] * 200 + [passage[:49]] * 200:
            texts.append(own(60) + part + own(60))
    # a text that repeats itself very often, and one other
    texts += [own(9) + ["u v w"] * 3000, ["u v w"] * 40 + own(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    compare(rows, suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 50)
    del texts[-2:], rows[-2:]
    assert len(suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 6
