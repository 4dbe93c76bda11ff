import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import same_rows
from tidegate.llm import infill, queries


def plain(text, doc_id):
    """The contract read literally, character by character."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if n == 0 or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM>é日\U0001f600\n\ŕ", max_size=60), st.integers(-5, 10**12))
def test_forms_and_round_trip(text, doc_id):
    got = infill.transformed(text, str(doc_id))
    assert got == plain(text, doc_id)
    assert infill.restored(got[4], got[1]) == text


def test_offsets_over_many_matches():
    for n in (0, 1, infill.AT_ONCE - 1, infill.AT_ONCE, infill.AT_ONCE + 1, 5 * infill.AT_ONCE + 7):
        text = "".join(random.Random(n).choice("aé日\U0001f600\n") for _ in range(n))
        assert list(infill.unit_ends(text)) == list(range(1, n + 1))


def test_other_units():
    assert list(infill.unit_ends("é́👩‍👩‍👧x\r\n", r"\X")) == [2, 7, 8, 10]
    assert list(infill.unit_ends("ab cd  ef ", r"\s*\S+")) == [2, 5, 10]
    assert list(infill.unit_ends("   ", r"\S+")) == [3]
    got = infill.transformed("one two three four", "5", unit=r"\s*\S+")
    assert got[0] == 4 and infill.restored(got[4], got[1]) == "one two three four"


def test_rows(spark):
    rows = [(1, "héllo wörld", "x"), (1, "héllo wörld", "x"), (None, "abc", None), (2, "", "y"), (3, None, "z"), (4, "a<M>b", ""), (5, "long \U0001f600" * 200_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = infill.fill_in_middle(df).collect()
    assert len(out) == len(rows)
    texts = {(i, t or "") for i, t, _ in rows}
    for r in out:
        text = next(t for i, t in texts if i == r.doc_id)
        n, form, a, b, made = plain(text, "" if r.doc_id is None else r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, a, b, made)
        assert r.output_sha256 == hashlib.sha256(made.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert infill.fill_in_middle(df.where(F.lit(False))).collect() == []
    assert "output" not in infill.fill_in_middle(df, output=False).columns


def test_query(spark):
    same_rows(spark, "/root/testdata/sf0.01", queries.QUERIES["op11_infill"], queries.ORACLES["op11_infill"])
