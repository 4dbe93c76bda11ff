"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that the one before kept.

1. quality: documents that a rule rejects go
2. near_duplicates: of documents linked by 5-word shingles at a similarity of 0.8, the one of smallest id stays
3. pii: personal values become pseudonyms
4. mixing: documents are taken as often as the mix of sources asks, up to three times
5. pieces: the piece ids of each document

Each stage takes whole texts of any length, any column may be null, other columns of documents pass through and an empty
table gives an empty table; what is special about nulls and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import jaccard, mixing, pieces, pii
from tidegate.llm import quality as rules
from tidegate.llm._scratch import written
from tidegate.llm.queries import query_key, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text has no words and goes. Rows are judged alone: repeated ones share their fate."""
    return rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words stay. Rows that repeat an id and a text count once; of a component without any id all stay."""
    return jaccard.without_copies(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text stays null. Every row stays, and n_chars counts the new text."""
    out = pii.pseudonymised(docs, query_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is one of its own. Null and empty texts are never taken; rows equal in id, text and source are taken
    equally often."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row, in the columns doc_id, source, n_pieces and ids; a null text has no pieces."""
    out = pieces.encoded(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", personal), ("mixing", mixed), ("pieces", encoded)]

#: Pseudonyms, draws and piece ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
