import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_quality import brute as verdict

from tidegate.llm import jaccard, mixing, pieces
from tidegate.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
PHONE = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}")
EMAIL = re.compile(r"[\w.]+@mail\d+\.example\.com")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert name == "pieces" or docs.columns == columns
        out[name] = docs.collect()
    good = {i for i, r in rows.items() if verdict(r.text)[-1]}
    assert {r.doc_id for r in out["quality"]} == good and len(out["quality"]) == len(good)
    alone = {d for d, _, c in components([(i, rows[i].text) for i in good], 5, 80, 100) if d == c}
    assert sorted(r.doc_id for r in out["near_duplicates"]) == sorted(alone)
    shown = {r.doc_id: r for r in out["pii"]}
    assert set(shown) == alone and all(r.n_chars == len(r.text) for r in shown.values())
    for i in alone:
        before = EMAIL.findall(rows[i].text)
        assert not any(e in shown[i].text for e in before)
        assert not any(p in shown[i].text for p in PHONE.findall(rows[i].text))
        if not re.search(r"[\d@]", rows[i].text):
            assert shown[i].text == rows[i].text
    copies = {}
    for r in out["mixing"]:
        assert r == shown[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    assert sorted(r.doc_id for r in out["pieces"]) == sorted(r.doc_id for r in out["mixing"])
    assert all(r.ids == m.library.encode(shown[r.doc_id].text) for r in out["pieces"])


def test_run_repeats_itself(spark):
    a, b = (sorted((r.doc_id, r.n_pieces) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark):
    text = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, 1), (None, text + " more", "en", "a", 1), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, text[::-1], "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = jaccard.without_copies(docs).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [1, 3, 4, 5]
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, SF)
        some.collect()
    assert mixing.mixed_rows(docs.where(F.lit(False))).collect() == []
