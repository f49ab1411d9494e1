"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wirelore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # Without call sites for error messages, building a plan from many columns is several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC; local time zones would move hour and day buckets."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    The cluster names that folder. Only a session that runs in one process (a laptop, a test) may do without and
    gets a temporary one; anywhere else a missing setting is an error, as executors don't see each other's disks. What
    is written there is deleted when the session's file system closes.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="wirelore-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes in this block are deleted at its end, but for those to be kept.

    Only for blocks whose results are written in them: what is still to be computed must not read those tables.
    """
    paths: list[str] = []
    before = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(before)
        delete_folders(spark, paths)


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor only costs a re-read.

    With ``keep`` it outlives a block of ``passing_tables``.
    """
    path = shared_folder(df.sparkSession, label)
    passing = _PASSING.get()
    if passing is not None and not keep:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
