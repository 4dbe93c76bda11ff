import gzip
import os
import random

from oracle import same_rows
from tidegate.llm import queries, warc

SF = "/root/testdata/sf0.001"


def brute(rows, least=0):
    top = {}
    for i, p in rows:
        top[p or ""] = max([x for x in (top.get(p or ""), i) if x is not None], default=None)
    out = []
    for i, p in rows:
        b, t = (p or "").encode(), top[p or ""]
        revisit = len(b) >= least and t is not None and (i is None or i < t)
        out.append((i, len(b), warc.base32_sha1(b), "revisit" if revisit else "response", t if revisit else None))
    return sorted(out, key=repr)


def cycle(spark, tmp_path, rows, **p):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([(i, f"http://x/{i}\r\n", t, b"z") for i, t in rows], "page_id long, url string, html string, key binary")
    warc.write_archives(df, path, **p)
    return warc.read_archives(spark, path)


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 700, "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nxx", "0\r\n\r\n", "\n" * 30, "日本" * 333]
    rows = [(i, rng.choice(texts) if i % 3 else "".join(rng.choice("aé\r\n0") for _ in range(rng.randint(0, 3000)))) for i in range(150)]
    rows += [(None, "only once"), (None, "a"), (None, "n"), (None, "n"), (5, rows[5][1]), (149, "é" * 700), (149, "é" * 700)]
    for k, p in enumerate(({}, {"segment_bytes": 100, "chunk_bytes": 7}, {"segment_bytes": 33, "chunk_bytes": 1000, "min_bytes": 10})):
        got = cycle(spark, tmp_path / str(k), rows, **p).select("*", warc.page_of("record_id").alias("i"), warc.page_of("refers_to").alias("r")).collect()
        assert all(r.valid for r in got)
        assert sorted(((r.i, r.payload_bytes, r.payload_digest, r.record_type, r.r) for r in got), key=repr) == brute(rows, p.get("min_bytes", 0))
        held = sorted(bytes(r.payload).decode() for r in got if r.record_type == "response" and r.i is not None)
        want = brute(rows, p.get("min_bytes", 0))
        assert len(held) == sum(1 for w in want if w[3] == "response" and w[0] is not None)


def test_damage_is_told(spark, tmp_path):
    pages = list(warc.records(1, "u", b"x" * 500, b"k" * 32, None, 100, 50))
    def read(some):
        d = tmp_path / os.urandom(4).hex()
        d.mkdir()
        with gzip.open(d / "a.warc.gz", "wb") as f:
            for r in some:
                f.write(r + b"\r\n\r\n")
        return warc.read_archives(spark, str(d)).collect()
    assert [(r.valid, bytes(r.payload)) for r in read(reversed(pages))] == [(True, b"x" * 500)]
    assert [r.valid for r in read(pages[:2] + pages[3:])] == [False]
    assert [r.valid for r in read(pages[:-1])] == [False]
    assert [r.valid for r in read(pages[1:])] == [False]
    assert [r.valid for r in read([pages[0].replace(b"xxx", b"xyx", 1), *pages[1:]])] == [False]
    assert [r.valid for r in read(pages + pages)] == [True, True]


def test_empty(spark, tmp_path):
    assert cycle(spark, tmp_path, []).collect() == []


def test_oracle(spark):
    same_rows(spark, SF, queries.QUERIES["op1_warc"], queries.ORACLES["op1_warc"])
