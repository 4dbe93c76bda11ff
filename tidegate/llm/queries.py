"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import infill, jaccard, mixing, pagetext, pieces, pii, quality, suffixes, superkmers, tokens, vectors, warc, whitening
from tidegate.llm._scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The key in spark.tidegate.pseudonym.key; where that is unset, a public one in local mode, for trials alone, and an error on a
    cluster: whoever has this text could undo those pseudonyms."""
    key = spark.conf.get("spark.tidegate.pseudonym.key", None)
    if not key:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.tidegate.pseudonym.key has to hold the key of the pseudonyms")
        key = "not a secret"
    return key


_drawn: dict[str, str] = {}


def query_key(spark: SparkSession) -> str:
    """``pseudonym_key``, and on a cluster without one a secret drawn at random, once an application: nobody can undo its
    pseudonyms, which are the same for equal values in that application and others in the next."""
    try:
        return pseudonym_key(spark)
    except ValueError as e:
        app = spark.sparkContext.applicationId
        if app not in _drawn:
            warnings.warn(f"{e}; this application takes a random one, whose pseudonyms link nothing with other applications'", stacklevel=2)
            _drawn[app] = secrets.token_hex(32)
        return _drawn[app]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    out = warc.read_archives(spark, path, payload=False)
    return out.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (SELECT page_id, h, top, sha1(h) AS x FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""


def op2_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.without_repeats(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS d FROM x),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM m, (SELECT unnest(range(50)) AS k) WHERE d < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept, count(*) AS n
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p WHERE c.p IS NULL GROUP BY e.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, text, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN r ON t.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words
            OR len(regexp_extract_all(text, '[!?]{2,}')) * 5 > n_words OR n_dup_lines * 2 > len(l)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) * 10 < n_words * 7
            OR len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) * 100 > len(l) * 30
            OR len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) * 100 > len(l) * 90) AS kept
FROM m
"""


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"), n=3, threshold=(90, 100))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(_table(spark, sf_dir, "documents"), query_key(spark), count="n_replaced")
    return out.select("doc_id", "n_replaced", "text")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decoded(pieces.encoded(docs, path), path)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(_table(spark, sf_dir, "documents"), output=False)


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(4), lambda i: ('0x' || substr(x, (1 + 8 * i)::INT, 8))::BIGINT) AS h FROM t),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, a::INT) AS p, substr(t, (a + 1)::INT, (b - a)::INT) AS m, substr(t, (b + 1)::INT) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_warc": op1_warc, "op2_superkmers": op2_superkmers, "op3_quality_rules": op3_quality_rules, "op4_jaccard": op4_jaccard, "op5_pii": op5_pii, "op6_near_vectors": op6_near_vectors,
    "op7_suffixes": op7_suffixes, "op8_pieces": op8_pieces, "op9_mixing": op9_mixing, "op10_token_counts": op10_token_counts, "op11_infill": op11_infill, "op12_whitening": op12_whitening,
    "op13_main_text": op13_main_text,
}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op2_superkmers": OP2_SQL, "op3_quality_rules": OP3_SQL, "op11_infill": OP11_SQL}
