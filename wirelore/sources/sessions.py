"""Session logs as tab-separated text or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import ecs_from_sessions
from ..schemas import SESSION_LOG_FIELDS, text_schema


def parse_session_lines(lines: DataFrame) -> DataFrame:
    """Typed sessions from the ``value`` lines of a conn log (S3).

    Comments, lines with fewer than ten fields and lines whose time or ports are not numbers are
    skipped; ``-`` is NULL.
    """
    fields = F.split(F.trim("value"), "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(fields.alias("f")).filter(F.size("f") >= 10)

    def text(i: int):
        return F.try_element_at("f", F.lit(i + 1))

    def dashed(i: int):
        return F.nullif(text(i), F.lit("-"))

    typed = rows.select(
        text(0).try_cast("double").alias("ts"), text(1).alias("uid"), text(2).alias("orig_h"),
        text(3).try_cast("int").alias("orig_p"), text(4).alias("resp_h"), text(5).try_cast("int").alias("resp_p"),
        text(6).alias("proto"), dashed(7).alias("service"), dashed(11).alias("conn_state"))
    return typed.filter(F.col("ts").isNotNull() & F.col("orig_p").isNotNull() & F.col("resp_p").isNotNull())


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return parse_session_lines(spark.read.text(path))


def _named(values, names):
    """The wanted fields of a line, by the column names of its file's header; without one by their usual places."""
    usual = F.array(*[F.lit(x) for x in SESSION_LOG_FIELDS])
    places = F.coalesce(names, usual)
    return [F.try_element_at(values, F.nullif(F.array_position(places, x), F.lit(0)).cast("int")).alias(x) for x in SESSION_LOG_FIELDS]


def read_session_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw session-log rows, all columns as text.

    Every line is taken for what it is, so files of both formats may lie in one folder: JSON objects, or values
    between tabs, where a quote is a character like any other. The ``#fields`` line of a file names its columns.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    is_json = F.ltrim("value").startswith("{")
    from_json = lines.filter(is_json).select(F.from_json("value", text_schema(SESSION_LOG_FIELDS)).alias("r")).select("r.*")
    heads = lines.filter(F.col("value").startswith("#fields")).groupBy("file").agg(F.max("value").alias("head"))
    heads = heads.select("file", F.slice(F.split("head", "\t"), 2, 1000).alias("names"))
    rows = lines.filter(~is_json & ~F.col("value").startswith("#") & (F.col("value") != ""))
    # One row per file; by a shuffle a task would get whole files.
    split = rows.join(F.broadcast(heads), "file", "left").select(F.split("value", "\t").alias("f"), "names")
    return split.select(*_named(F.col("f"), F.col("names"))).unionByName(from_json)


def session_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files below a path that hold session logs, and the others. A session log has a ``#separator`` line or JSON objects."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    mark = F.col("value").startswith("#separator") | F.col("value").startswith('{"')
    kinds = lines.groupBy("file").agg(F.bool_or(mark).alias("session")).collect()  # one row per file
    return sorted(r["file"] for r in kinds if r["session"]), sorted(r["file"] for r in kinds if not r["session"])


def read_sessions_as_ecs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S4."""
    return ecs_from_sessions(read_session_log(spark, path))
