"""Streams over the event rows: landing files in the shared folder, run until they are used up, read back as rows.

A windowed query in append mode gives out what the watermark has passed, so its SQL asks for the windows that end
before the newest event less the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import events_from_packets
from ..session import shared_folder
from ..sources.packets import read_packet_fields
from ..streaming import beacons, ingest, windows
from .core import query
from .detector_queries import _GAPS, _rounded_intervals
from .io_queries import _EVENT_COLUMNS, _FROM_PACKETS, _written, packet_export
from .views import view

DELAY = "10 minutes"


def event_files(spark, sf) -> DataFrame:
    """The event rows as a stream of written files."""
    rows = view(spark, sf, "v_events").select("t", F.col("ts").cast("timestamp").alias("ts"), "si", "di", "dp", "bytes_sent", "bytes_recv")
    path = _written(rows, "landing-events", "parquet")
    return spark.readStream.schema(rows.schema).parquet(path)


def finished(stream: DataFrame, label: str) -> DataFrame:
    """The rows of a stream that is run over all its files, appended to files of their own."""
    spark = stream.sparkSession
    out, checkpoint = shared_folder(spark, label), shared_folder(spark, f"{label}-checkpoint")
    started = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_event_store", ids="P1 K1", views="v_events", sql=_FROM_PACKETS + " select *, cast(to_timestamp(t) as date) as event_date from e")
def stream_event_store(spark, sf):
    landing = _written(packet_export(spark, sf), "landing", "csv", header=True)
    fields = packet_export(spark, sf).columns
    store = shared_folder(spark, "stream-store")
    ingest.store_events(ingest.event_stream(spark, landing, fields), store, shared_folder(spark, "stream-store-checkpoint")).awaitTermination()
    return ingest.stored_events(spark, store).select(*_EVENT_COLUMNS, "event_date")


@query("stream_store_equals_batch", ids="P1 K1", views="v_events", sql=_FROM_PACKETS + " select count(*) as events, cast(0 as bigint) as differing from e")
def stream_store_equals_batch(spark, sf):
    """Events of the streamed store against the batch reader's over the same files, as a multiset."""
    landing = _written(packet_export(spark, sf), "landing", "csv", header=True)
    store = shared_folder(spark, "stream-store")
    ingest.store_events(ingest.event_stream(spark, landing, packet_export(spark, sf).columns), store, shared_folder(spark, "stream-store-checkpoint")).awaitTermination()
    streamed = ingest.stored_events(spark, store).select(*_EVENT_COLUMNS, F.lit(1).alias("_s"))
    batch = events_from_packets(read_packet_fields(spark, landing)).select(*_EVENT_COLUMNS, F.lit(-1).alias("_s"))
    sums = streamed.unionByName(batch).groupBy(*_EVENT_COLUMNS).agg(F.sum("_s").alias("_s"), F.count_if(F.col("_s") > 0).alias("_n"))
    return sums.agg(F.sum("_n").alias("events"), F.count_if(F.col("_s") != 0).alias("differing"))


_WINDOWED = """with w as (select *, time_bucket(interval '{width}', ts, timestamp '1970-01-01') as window_start from v_events where si is not null and di is not null),
      m as (select max(ts) - interval '10 minutes' as passed from v_events where si is not null and di is not null)"""
_CLOSED = "window_start, window_start + interval '{width}' as window_end"


def _sql(width: str, columns: str, groups: str, tail: str = "") -> str:
    return _WINDOWED.format(width=width) + f""",
      g as (select {_CLOSED.format(width=width)}, {columns} from w group by window_start{groups})
    select g.*{tail} from g, m where window_end <= passed"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_port_scans", ids="D4", views="v_events", sql=_sql(
    "1 hour", "si, count(distinct dp) as unique_ports", ", si having count(dp) > 0", ", unique_ports > 3 as flagged"))
def stream_port_scans(spark, sf):
    return _shown(finished(windows.port_scans(event_files(spark, sf), "1 hour", DELAY, 3), "stream-ports"))


@query("stream_network_scans", ids="D5", views="v_events", sql=_sql(
    "6 hours", "si, count(distinct di) as unique_destinations", ", si", ", unique_destinations > 3 as flagged"))
def stream_network_scans(spark, sf):
    return _shown(finished(windows.network_scans(event_files(spark, sf), "6 hours", DELAY, 3), "stream-networks"))


@query("stream_transfers", ids="D6", views="v_events", sql=_sql(
    "1 hour", "si, di, dp, cast(sum(bytes_sent) as bigint) as bytes_sent, cast(sum(bytes_recv) as bigint) as bytes_recv, count(*) as packets", ", si, di, dp",
    ", bytes_sent + bytes_recv as total_bytes, bytes_sent + bytes_recv > 100000 as flagged"))
def stream_transfers(spark, sf):
    return _shown(finished(windows.transfers(event_files(spark, sf), "1 hour", DELAY, threshold=100_000), "stream-transfers"))


@query("stream_activity", ids="A9", views="v_events", sql=_sql("15 minutes", "count(*) as events", ""))
def stream_activity(spark, sf):
    known = event_files(spark, sf).filter("si is not null and di is not null")
    return _shown(finished(windows.activity(known, "15 minutes", DELAY), "stream-activity"))


@query("stream_beacons", ids="D1", views="v_events", sql=_GAPS.format(key="si, dp", src="v_events") + """,
      last as (select si, dp, max(t) as newest from v_events group by all)
    select si, dp, intervals, intervals + 1 as events, round(m, 4) as interval_avg, round(sd, 4) as interval_stddev, round(cv, 6) as cv,
      round(entropy, 6) + 0.0 as entropy, case when cv < 0.05 then 'HIGH' else 'MEDIUM' end as confidence,
      cv < 0.4 and entropy < 3 and m > 1 and m < 1e9 as flagged
    from c join last using (si, dp) where newest + 3600 <= (select max(t) - 600 from v_events)""")
def stream_beacons(spark, sf):
    """Connections (source and port) that have been silent for an hour at the end of the stream."""
    found = beacons.beacon_stream(event_files(spark, sf), ("si", "dp"), delay=DELAY, max_cv=0.4, max_entropy=3, max_interval=1e9)
    return _rounded_intervals(finished(found, "stream-beacons"))
