"""Texts of two million characters: with spaces, without any, and repeating themselves without end."""

import hashlib
import random
import time

import pytest

from tidegate.llm import jaccard, mixing, pieces, pii, quality, suffixes, superkmers, tokens, warc
from tidegate.llm.queries import tokenizer_path

rng = random.Random(4)
PROSE = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(260_000))
SOLID = "".join(rng.choice("abcdefghij") for _ in range(2_000_000))
SAME = "again " * 340_000
TEXTS = {1: PROSE, 2: SOLID, 3: SAME, 4: SAME + "and more", 5: PROSE[: 1_000_000], 6: SOLID[:-1] + "z"}
WORDS = {i: t.split() for i, t in TEXTS.items()}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "t")
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def quick():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < 120


def test_superkmers(docs):
    got = {r.doc_id: r for r in superkmers.without_repeats(docs).collect()}
    kept = {i: [] if i in (4, 5) else w for i, w in WORDS.items()}
    kept[4] = ["and", "more"]
    # the passage ends within a word of the longer text
    kept[5] = [] if WORDS[5] == WORDS[1][: len(WORDS[5])] else WORDS[5][-1:]
    # the first windows of text 4 stand in text 3; those that reach its end don't
    for i, w in WORDS.items():
        assert got[i].n_words == len(w) and got[i].n_removed == len(w) - len(kept[i]), i
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept[i]).encode()).hexdigest(), i


def test_suffixes(docs):
    found = {r.doc_id: (r.start_word, r.n_words, r.other_id) for r in suffixes.repeated_passages(docs).collect()}
    n = len(WORDS[5]) - (WORDS[5] != WORDS[1][: len(WORDS[5])])
    assert found == {1: (0, n, 5), 5: (0, n, 1), 3: (0, 340_000, 4), 4: (0, 340_000, 3)}


def test_jaccard(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, n=3, threshold=(90, 100)).collect()}
    shingles = {i: len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) for i, w in WORDS.items()}
    assert got == {i: (shingles[i], i) for i in TEXTS}


def test_quality_and_pii(docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 5} and all(got[i].n_words == len(w) for i, w in WORDS.items())
    out = {r.doc_id: (r.text, r.n) for r in pii.pseudonymised(docs, "k", count="n").collect()}
    assert out == {i: (t, 0) for i, t in TEXTS.items()}


def test_mixing(docs):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all(got[i].size == len(w) for i, w in WORDS.items()) and sum(r.taken for r in got.values()) == sum(map(len, WORDS.values()))


def test_pieces(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    some = docs.where("doc_id IN (2, 3, 5)")
    got = {r.doc_id: r for r in pieces.decoded(pieces.encoded(some, path), path).collect()}
    m = pieces.model(path)
    assert all(r.decoded == TEXTS[i] for i, r in got.items()) and set(got) == {2, 3, 5}
    assert got[3].ids == m.library.encode(TEXTS[3]) and got[5].ids == m.library.encode(TEXTS[5])


def test_tokens(docs):
    path = tokenizer_path("word_bpe_49k.json")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs.where("doc_id IN (3, 5)"), path).collect()}
    t = tokens.tokenizer(path)
    assert got == {i: len(t.encode(TEXTS[i], add_special_tokens=False).ids) for i in got} and set(got) == {3, 5}


def test_warc(spark, docs, tmp_path):
    warc.write_archives(docs, str(tmp_path / "w"), id="doc_id", url="lang", html="text")
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.valid for r in got) and sorted(hashlib.md5(r.payload).hexdigest() for r in got) == sorted(hashlib.md5(t.encode()).hexdigest() for t in TEXTS.values())


def test_archives_by_size(spark, tmp_path):
    """As many archives as the payload asks for, with fewer shuffle partitions than that."""
    pages = spark.range(400).selectExpr("id AS page_id", "'http://x' AS url", "repeat(sha2(cast(id AS string), 512), 20) AS html")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=1 << 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = [sum(len(p) for p in warc.inflated(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) == 16 and max(sizes) < 3 << 16
    assert warc.read_archives(spark, str(tmp_path / "w"), payload=False).where("valid").count() == 400
