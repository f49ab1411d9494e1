"""Event store, tickets and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT_SCHEMA, TICKET_SCHEMA
from ..operators.normalize import align

# Names of the event tables.
EVENT_TABLES = ["events", "purified_events", "toon_events", "assets", "reputation"]


def append_events(events: DataFrame, path: str) -> int:
    """Append normalised events partitioned by UTC date and return how many (K1).

    The count is taken while writing. Rows are rebalanced by date first: a date is written by few tasks, and
    Spark splits a busy one. A later time filter on ``event_date`` prunes folders.
    """
    written = Observation("events")
    dated = events.select(EVENT_SCHEMA.fieldNames()).withColumn("event_date", F.to_date(F.timestamp_micros((F.col("t") * 1e6).cast("long"))))
    counted = dated.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)
    return written.get["rows"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ingestion_counters(raw: DataFrame, normalised: DataFrame, alerts_matched: DataFrame) -> DataFrame:
    """Rows extracted, normalised and matched by an alert (A46), as one row."""
    counted = [df.agg(F.count(F.lit(1))).scalar() for df in (raw, normalised, alerts_matched)]
    names = ("events_extracted", "events_normalized", "alerts_matched")
    return raw.sparkSession.range(1).select([n.alias(x) for n, x in zip(counted, names)])


def append_tickets(tickets: DataFrame, path: str) -> None:
    """K2."""
    align(tickets, TICKET_SCHEMA).write.mode("append").parquet(path)


def create_ticket(spark: SparkSession, path: str, **fields) -> None:
    """Append one ticket."""
    row = Row(*TICKET_SCHEMA.fieldNames())(*[fields.get(x) for x in TICKET_SCHEMA.fieldNames()])
    append_tickets(spark.createDataFrame([row], TICKET_SCHEMA), path)


def export_parquet(df: DataFrame, path: str) -> None:
    """K3."""
    df.write.mode("overwrite").parquet(path)


def drop_tables(spark: SparkSession, names: Sequence[str] = EVENT_TABLES) -> None:
    """K4."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def table_view(events: DataFrame) -> DataFrame:
    """The six columns of the event table, with ISO time."""
    stamp = F.date_format(F.timestamp_micros((F.col("t") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    blank = lambda name: F.coalesce(name, F.lit(""))
    return events.select(
        stamp.alias("Timestamp"), blank("si").alias("Source IP"), blank("di").alias("Dest IP"), F.col("pr").alias("Protocol"),
        blank("zeek_service").alias("Service"), blank("alert_msg").alias("Alert"))


def export_table(events: DataFrame, path: str, kind: str = "csv") -> None:
    """The event table as quoted CSV, or all columns as JSON lines (K5)."""
    if kind == "csv":
        table_view(events).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    else:
        events.write.mode("overwrite").json(path)
