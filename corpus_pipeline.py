"""Clean and pack the documents: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage gets what the one before it kept; all but the last return the columns of documents. Near duplicates and leaks are
told by a written row number, so rows without id go like others and of rows that repeat an id only those concerned go; of
a group one row stays. Toxicity is learned and judged by id: a row without id stays there, rows of
one id share its fate. Texts of any length are taken whole, other columns pass through, empty tables pass every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelore.llm import decontaminate, near_dedup, packing, pii, toxicity
from wirelore.llm.queries import public_vocabulary
from wirelore.llm.tables import table
from wirelore.session import cut_lineage, passing_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rejected(spark: SparkSession, judge: Callable[[], DataFrame], key: str) -> DataFrame:
    """The ids that ``judge`` gives, written under the name ``key``, so that its plan runs once.

    The tables made on the way to them go with that: a stage leaves no more than its rows and these in the shared folder."""
    with passing_tables(spark):
        return cut_lineage(judge().select(F.col("doc_id").alias(key)).distinct(), "rejected", keep=True)


ROW = "row_of_stage"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a written number, in the order of their ids within a task's share."""
    numbered = docs.sortWithinPartitions(F.col("doc_id").asc_nulls_last()).withColumn(ROW, F.monotonically_increasing_id())
    return cut_lineage(numbered, "numbered")


def _by_row(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col(ROW).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on the labelled part of ``docs``."""
    toxic = _rejected(spark, lambda: toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"), "doc_id")
    return docs.join(toxic, "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    numbered = _numbered(docs)
    copies = _rejected(spark, lambda: near_dedup.link_documents(_by_row(numbered)).filter("not kept"), ROW)
    return numbered.join(copies, ROW, "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    numbered = _numbered(docs)
    leaks = _rejected(spark, lambda: decontaminate.find_leaks(_by_row(numbered), table(spark, sf_dir, "benchmark")), ROW)
    return numbered.join(leaks, ROW, "left_anti").select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 2048-token sequences, with their ids."""
    return packing.pack(docs, public_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("benchmark_leaks", drop_benchmark_leaks), ("pii", mask_pii), ("packing", pack_documents)]

# Trained models and tokenizers are beyond SQL; tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
