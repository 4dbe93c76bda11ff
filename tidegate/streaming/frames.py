"""A sink of frames that takes each batch once, as a Python data source.

Tasks write files of their own; the commit of a batch is one small list of them, which is made by renaming, so it is there whole or not at all. A batch
that comes again, after a driver was lost between commit and checkpoint, finds its list and its files are deleted. Readers see listed
files only. Files are reached through Arrow's file systems, so the path may be a URI that these know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "tidegate_frames"
#: Rows that a task holds before it writes them.
HELD_ROWS = 10_000


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = _at(self.path)
        schema, name, writer, held, n = to_arrow_schema(self.schema), f"{uuid.uuid4().hex}.parquet", None, [], 0

        def flush() -> None:
            nonlocal writer, held
            if writer is None:
                fs.create_dir(f"{base}/data", recursive=True)
                writer = pq.ParquetWriter(f"{base}/data/{name}", schema, filesystem=fs)
            writer.write_table(pa.Table.from_pylist(held, schema))
            held = []

        for r in iterator:
            held.append(r.asDict())
            n += 1
            if len(held) >= HELD_ROWS:
                flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, base = _at(self.path)
        files = [m.file for m in messages if m is not None and m.file]
        target = f"{base}/commits/{batchId:020d}.json"
        if fs.get_file_info(target).type != pa.fs.FileType.NotFound:
            for f in files:
                fs.delete_file(f"{base}/data/{f}")
            return
        fs.create_dir(f"{base}/commits", recursive=True)
        fs.create_dir(f"{base}/making", recursive=True)
        making = f"{base}/making/{uuid.uuid4().hex}"
        with fs.open_output_stream(making) as out:
            out.write(json.dumps({"batch": batchId, "files": files}).encode())
        fs.move(making, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, base = _at(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{base}/data/{m.file}")


class FrameSource(DataSource):
    """Option path: a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], schema)


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The frames of all committed batches, with batch. Rows of a listed file only: files of batches that broke off are left out."""
    listed = spark.read.schema("batch long, files array<string>").json(f"{path}/commits").select("batch", F.explode("files").alias("__file"))
    rows = spark.read.schema(schema).parquet(f"{path}/data").withColumn("__name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(listed, F.col("__name") == F.col("__file")).drop("__name", "__file")


def deliver(frames: DataFrame, path: str, checkpoint: str):
    """Starts appending frames to the folder."""
    frames.sparkSession.dataSource.register(FrameSource)
    return frames.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
