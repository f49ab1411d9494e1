"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folders, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows per Arrow batch of documents. A batch is held several times over in a Python worker and outside the JVM's heap.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Documents are long: send them to Python in batches of BATCH_ROWS. It is a setting of the session and stays, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def free_finished(context: SparkContext, last: bool = False) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage: ask for that between large steps.

    The JVM hears within a second that Python has dropped a table; ``last`` waits for that, so that the files of the step just
    finished go too.
    """
    gc.collect()
    if last:
        time.sleep(1.2)
    context._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder on the way, to be discarded when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_folder(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        delete_folders(self.spark, self.paths)
        self.paths.clear()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns can't clash; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; -1 for a row without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % buckets, F.lit(-1))
