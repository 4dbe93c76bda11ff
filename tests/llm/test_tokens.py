import random

import pytest
from pyspark.sql import functions as F

from tidegate.llm import queries, tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 4), (200, 30)])
def test_splices_equal_whole(chunk, overlap):
    t = tokenizers_of()
    rng = random.Random(chunk)
    alphabet = ["the", "Ça", "don't", "a", "  ", "\n", " ", " ", "x" * 90, "é", "é", "9", "42!!", "<|endoftext|>", "***", "日本語", " ", "'s", "́"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120)))
        want = t.encode(text, add_special_tokens=False).ids
        assert [i for part in tokens.spliced_ids(t, text, chunk, overlap) for i in part] == want


def test_no_white_space_at_all():
    t = tokenizers_of()
    text = "abc" * 4000
    assert tokens.count(t, text, 100, 10) == len(t.encode(text, add_special_tokens=False).ids)


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (2, "", "y"), (3, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, PATH, chunk=500, overlap=20).collect())
    assert got == [(0, 0, 0, False), (1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (3, 25000, 5000, True)]
    assert tokens.token_counts(df.where(F.lit(False)), PATH).collect() == []


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    t = tokenizers_of()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, queries.QUERIES["op10_token_counts"](spark, sf).collect())) == sorted(want)


def tokenizers_of():
    return tokens.tokenizer(PATH)
