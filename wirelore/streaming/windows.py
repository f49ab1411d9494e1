"""Detectors over event-time windows (D4, D5, D6, A9), for streams and batches alike.

``events`` has a timestamp ``ts``. ``delay`` is how late an event may come. On a stream in append mode a window's row
appears when the watermark has passed its end, and its state goes; later events of it are dropped. A batch gives the
same rows, as it knows no late events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import CONNECTION


def _windowed(events: DataFrame, width: str, delay: str) -> DataFrame:
    known = events.filter(F.col("si").isNotNull() & F.col("di").isNotNull())
    return known.withWatermark("ts", delay).withColumn("window", F.window("ts", width))


def _bounds(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *columns)


def _distinct_per_source(events: DataFrame, value: str, name: str, least: int, width: str, delay: str) -> DataFrame:
    # First the state drops duplicates of (window, source, value), then what is left is counted: one small row per
    # value, so a busy source is spread over its values before it is counted.
    once = _windowed(events, width, delay).filter(F.col(value).isNotNull()).select("window", "si", value).dropDuplicates(["window", "si", value])
    counted = once.groupBy("window", "si").agg(F.count(F.lit(1)).alias(name))
    return _bounds(counted, "si", name).withColumn("flagged", F.col(name) > least)


def port_scans(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", scan_ports: int = 20) -> DataFrame:
    """Distinct destination ports per source and window."""
    return _distinct_per_source(events, "dp", "unique_ports", scan_ports, width, delay)


def network_scans(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", scan_destinations: int = 15) -> DataFrame:
    """Distinct destinations per source and window."""
    return _distinct_per_source(events, "di", "unique_destinations", scan_destinations, width, delay)


def transfers(
    events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", keys: Sequence[str] = CONNECTION, threshold: int = 100_000_000,
) -> DataFrame:
    """Bytes per connection and window, in both directions."""
    sent, received = F.sum(F.coalesce("bytes_sent", F.lit(0))), F.sum(F.coalesce("bytes_recv", F.lit(0)))
    totals = _windowed(events, width, delay).groupBy("window", *keys).agg(
        sent.alias("bytes_sent"), received.alias("bytes_recv"), F.count(F.lit(1)).alias("packets"))
    rows = _bounds(totals, *keys, "bytes_sent", "bytes_recv", "packets")
    total = F.col("bytes_sent") + F.col("bytes_recv")
    return rows.withColumn("total_bytes", total).withColumn("flagged", total > threshold)


def activity(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Events per window (A9), by ``keys`` if there are any."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return _bounds(counted, *keys, "events")
