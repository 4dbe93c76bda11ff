"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of an Arrow batch of texts: Spark and Python each hold one.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="tidegate-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tidegate-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there and lost executors cost no rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs within; the session's own settings hold again afterwards."""
    before = [(key, spark.conf.get(key, None)) for key in (_ROWS, _BYTES)]
    small_batches(spark)
    try:
        yield
    finally:
        for key, value in before:
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches from now on: for frames that are returned before they run, which read the settings only then."""
    for key, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark.conf.get(key, None) or "0"
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written so; call it once results are stored."""
    jvm = spark.sparkContext._jvm
    for path in _made.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
