import random

import pytest

from tidegate.llm import pieces, queries

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SYLLABLES = ["the", "tion", "é", "ing", "ß", "qu", "A", "日本", "\n", "\t", " ", "  ", "   ", "x", "...", "12", "▁", "🙂", "\x01", "ation", "st", "://", "\r\n", "ñ", "oo", "aaaa"]


def lists(m, texts):
    bounds, ids = m.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_equals_library():
    m, rng = pieces.model(PATH), random.Random(2)
    texts = ["", " ", "a", "▁", "  a", "a ", "\n"] + ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ETAé") for _ in range(200)) for _ in range(200)]
    assert lists(m, texts) == m.library.encode(texts)
    for t in texts:
        ids = m.library.encode(t)
        assert m.decode(ids) == m.library.decode(ids)


def handmade():
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, m = random.Random(8), pb.ModelProto()
    m.trainer_spec.model_type = pieces.UNIGRAM
    m.trainer_spec.unk_surface = " ⁇ "
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for i, p in enumerate(["<unk>", "<s>", "</s>"]):
        m.pieces.add(piece=p, score=0, type=2 if i == 0 else 3)
    made = {"▁", "a", "b", "c", "▁▁"} | {rng.choice(["", "▁"]) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    for p in sorted(made):
        m.pieces.add(piece=p, score=-rng.random() * 8 - 1, type=1)
    return m.SerializeToString()


def test_unigram_viterbi_equals_library():
    m, rng = pieces.Model(handmade()), random.Random(3)
    texts = ["".join(rng.choice("aaabbbccc  dé\n") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    assert lists(m, texts) == m.library.encode(texts)


def test_prefixes_are_shared(monkeypatch):
    m, steps = pieces.Model(open(PATH, "rb").read()), []
    real = m._bpe_forward
    monkeypatch.setattr(m, "_bpe_forward", lambda word, same, *a: steps.append(len(word) - same) or real(word, same, *a))
    list(m.encode_words({"▁" + "abc" * 10 + x for x in "abcdefg"}))
    assert sum(steps) == 31 + 7


def test_rows(spark):
    rows = [(1, "Hello  wörld\n", [9]), (1, "Hello  wörld\n", [9]), (None, None, None), (2, "", None), (3, "long " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    out = pieces.decoded(pieces.encoded(df, PATH), PATH).collect()
    m = pieces.model(PATH)
    for r in out:
        assert r.ids == m.library.encode(r.text or "") and r.decoded == (r.text or "")
    assert len(out) == 5 and pieces.encoded(df.limit(0), PATH).collect() == []
    assert pieces.decoded(df.drop("text"), PATH).where("ids is null").first().decoded is None


def test_query(spark):
    m = pieces.model(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == m.library.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.round_trip


def test_blocks_are_a_million_characters_at_most():
    # four million took 90 MB more of each worker, and the pipeline over an executor's memory at 0.6 GB
    sizes = [100_000] * 60 + [3_000_000] + [100_000] * 5
    parts = list(pieces._slices(sizes, pieces.BLOCK_CHARS))
    assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(sizes)))
    assert all(hi - lo == 1 or sum(sizes[lo:hi]) <= 1 << 20 for lo, hi in parts)
