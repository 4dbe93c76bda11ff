"""Counts, listings and state of the service and of the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of object in the order of the summary, and what the lines of one are called.
KINDS = {"Catalogs": "Catalog", "Documents": "Document", "Information Registers": "InformationRegister", "Accumulation Registers": "AccumulationRegister"}


@dataclass
class Settings:
    """What the service was started with."""

    running: bool = True
    port: int = 8765
    logging_enabled: bool = False
    log_path: str = ""
    token: str = ""
    version: str = "1.0"


def one_row(**parts: DataFrame) -> DataFrame:
    """A row of counts, one for each frame."""
    counted = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in parts.items()]
    return reduce(DataFrame.crossJoin, counted)


def service_status(settings: Settings, pending: DataFrame, tools: DataFrame, resources: DataFrame, prompts: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: the counts of open requests, definitions and sessions, and the settings, in order of name."""
    counts = one_row(pending_requests=pending, tools_registered=tools, resources_registered=resources, prompts_registered=prompts, active_sessions=sessions)
    known = {"running": settings.running, "port": settings.port, "logging_enabled": settings.logging_enabled, "log_path": settings.log_path, "auth_enabled": bool(settings.token), "version": settings.version}
    return counts.withColumns({k: F.lit(v) for k, v in known.items()}).select(*sorted([*counts.columns, *known]))


def runtime_status(log: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The runtime's state after its log, for each of ``keys`` or for all: one row of nine fields.

    The log has request_id, tool, step (start, progress, success or failure; others are ignored), progress, total, message
    and updated_at. Each field is the value of the last step that sets it, so sums are combined before the shuffle.
    """
    step, at = F.col("step"), F.struct(*order)

    def last(value: Column, *steps: str, start: Column) -> Column:
        return F.coalesce(F.max_by(value, F.when(step.isin(*steps), at)), start)

    empty, zero = F.lit(""), F.lit(0)
    ended = ("start", "success", "failure")
    message = F.when(step == "start", "Started.").when(step == "progress", F.col("message")).when(step == "success", "Completed.").otherwise("Failed.")
    fields = [
        last(step == "start", *ended, start=F.lit(False)).alias("IsBusy"),
        last(F.col("request_id"), "start", start=empty).alias("CurrentRequestID"),
        last(F.col("tool"), "start", start=empty).alias("CurrentTool"),
        last(F.when(step == "start", 0).otherwise(F.col("progress")), "start", "progress", start=zero).alias("Progress"),
        last(F.col("total"), "start", "progress", start=zero).alias("Total"),
        last(message, "start", "progress", "success", "failure", start=F.lit("Idle")).alias("ProgressMessage"),
        last(F.col("message"), "success", start=empty).alias("LastResult"),
        last(F.when(step == "failure", F.col("message")).otherwise(empty), *ended, start=empty).alias("LastError"),
        last(F.col("updated_at"), "start", "progress", "success", "failure", start=empty).alias("UpdatedAt"),
    ]
    return log.groupBy(*keys).agg(*fields)


def combined(runtime: DataFrame, component: DataFrame | None) -> DataFrame:
    """One row of two structs, componentStatus and runtimeStatus; a service that isn't there is one that doesn't run."""
    state = runtime.select(F.struct(*sorted(runtime.columns)).alias("runtimeStatus"))
    if component is None:
        return state.select(F.struct(F.lit(False).alias("running")).alias("componentStatus"), "runtimeStatus")
    return component.select(F.struct(*sorted(component.columns)).alias("componentStatus")).crossJoin(state)


def names(df: DataFrame, name: str) -> DataFrame:
    """One row: the distinct names, sorted and joined by |. It is one text, so one task puts them together."""
    return df.select(name).distinct().agg(F.array_join(F.sort_array(F.collect_list(name)), "|").alias("names"))


def synonym(name: str) -> str:
    return name.replace("_", " ").capitalize()


def catalog_metadata(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, synonym, attributeCount and tabularsCount (columns that hold rows) of each table, from schemas alone."""
    rows = [(name, synonym(name), len(df.schema), sum(isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) for f in df.schema)) for name, df in tables.items()]
    return spark.createDataFrame(rows, "name string, synonym string, attributeCount int, tabularsCount int")


def metadata_summary(objects: DataFrame) -> DataFrame:
    """The listing of objects (kind, pos, name) as one text: a count of each kind, then a line for each catalog and document in order of pos. Other
    kinds are ignored. It is one text, so one task puts its lines together."""
    labels = list(KINDS)
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("kind")) - 1
    own = F.get(F.array(*map(F.lit, KINDS.values())), number.cast("int"))
    spaced = F.replace(F.col("name"), F.lit("_"), F.lit(" "))
    title = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 1 << 30)))
    lines = objects.where(F.col("kind").isin(*labels)).select(number.alias("k"), "pos", F.concat(F.lit("  - "), own, F.lit("."), "name", F.lit(" ("), title, F.lit(")\n")).alias("line"))
    counts = [F.concat(F.lit(f"{label}: "), F.count_if(F.col("k") == k).cast("string"), F.lit("\n")) for k, label in enumerate(labels)]
    listed = F.array_sort(F.collect_list(F.when(F.col("k") < 2, F.struct("k", "pos", "line"))))
    return lines.agg(F.concat(*counts, F.array_join(F.transform(listed, lambda x: x["line"]), "")).alias("summary"))


def long_task(df: DataFrame, step: str, value: str) -> DataFrame:
    """step, total: the sum of a column's values mod 97 in each step."""
    return df.groupBy(F.col(step).alias("step")).agg(F.sum(F.col(value) % 97).alias("total"))
