"""Packet exports as a stream: a landing folder in, an event store out (P1 and K1 without a batch job).

Offsets live in the stream's checkpoint. The sink writes every micro-batch to a folder of its own, named by the batch's
number, and replaces that folder when a batch is tried again. So a batch counts once, however often it was started.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import events_from_packets
from ..schemas import EVENT_SCHEMA, PACKET_FIELDS


def packet_stream(spark: SparkSession, folder: str, fields: Sequence[str] = PACKET_FIELDS, files_per_batch: int | None = None) -> DataFrame:
    """New files of a landing folder as rows of text columns.

    ``fields`` are the columns of the exports in their order; a file with another header is an error, not shifted columns.
    """
    reader = spark.readStream.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    reader = reader.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def event_stream(spark: SparkSession, folder: str, fields: Sequence[str] = PACKET_FIELDS, files_per_batch: int | None = None) -> DataFrame:
    """The normalised events of a landing folder, with their time as ``ts``; malformed rows are dropped as in a batch."""
    events = events_from_packets(packet_stream(spark, folder, fields, files_per_batch), folder)
    return events.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def batch_folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/batch={number:012d}"


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a date-partitioned folder per batch, replaced when the batch is repeated."""

    def write(events: DataFrame, number: int) -> None:
        dated = events.select(*EVENT_SCHEMA.fieldNames(), F.to_date("ts").alias("event_date"))
        # Static replacement: what an earlier try left in any date of this batch goes.
        writer = dated.hint("rebalance", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("event_date").parquet(batch_folder(path, number))

    return write


def store_events(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start writing a stream of events; without ``every`` all that is there is processed and the query ends."""
    writer = events.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of all batches; ``batch`` and ``event_date`` are folders, so filters on them prune."""
    dated = T.StructType([*EVENT_SCHEMA.fields, T.StructField("batch", T.StringType()), T.StructField("event_date", T.DateType())])
    return spark.read.schema(dated).parquet(path)
