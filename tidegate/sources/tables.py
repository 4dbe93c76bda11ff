"""Parquet tables by name, read through Spark so that any store Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def opened(spark: SparkSession) -> SparkSession:
    """The session with the one setting that reading messages needs, for good: of a key that an object has twice, the last value
    holds."""
    if spark.conf.get(DUPLICATE_KEYS, None) != "true":
        spark.conf.set(DUPLICATE_KEYS, "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return opened(spark).read.parquet(f"{sf_dir}/{name}.parquet")
