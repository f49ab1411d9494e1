"""Event filters, table search and paging (F family)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import NO_FLOW_ID
from ..functions.columns import c


def _utc_date(t: float) -> date:
    return (datetime(1970, 1, 1) + timedelta(seconds=t)).date()


def query_events(
    events: DataFrame,
    start: float | None = None,
    end: float | None = None,
    src: str | None = None,
    dst: str | None = None,
    protocol: str | None = None,
    limit: int | None = None,
    tiebreak: Sequence[str] = ("si", "di"),
) -> DataFrame:
    """Events matching every given condition, newest first (F1). Both time bounds are inclusive.

    On a store with date folders the time bounds also become bounds on the date, which prunes folders.
    """
    conditions = []
    if "event_date" in events.columns:
        conditions += [F.col("event_date") >= F.lit(_utc_date(start))] if start is not None else []
        conditions += [F.col("event_date") <= F.lit(_utc_date(end))] if end is not None else []
    if start is not None:
        conditions.append(F.col("t") >= start)
    if end is not None:
        conditions.append(F.col("t") <= end)
    if src is not None:
        conditions.append(F.col("si") == src)
    if dst is not None:
        conditions.append(F.col("di") == dst)
    if protocol is not None:
        conditions.append(F.col("pr") == protocol.lower())
    for condition in conditions:
        events = events.filter(condition)
    ordered = events.orderBy(F.col("t").desc(), *tiebreak)
    return ordered if limit is None else ordered.limit(limit)


def around(df: DataFrame, ts: str, t0: datetime | Column, hours: float = 24) -> DataFrame:
    """Rows within ``hours`` of ``t0``, both ends included."""
    if isinstance(t0, Column):
        low = t0 - F.make_dt_interval(hours=F.lit(int(hours)))
        high = t0 + F.make_dt_interval(hours=F.lit(int(hours)))
    else:
        low, high = F.lit(t0 - timedelta(hours=hours)), F.lit(t0 + timedelta(hours=hours))
    return df.filter(c(ts).between(low, high))


def search(df: DataFrame, needles: Mapping[str, str]) -> DataFrame:
    """Case-insensitive substring search per column; all must match, empty needles are ignored."""
    for name, needle in needles.items():
        if needle:
            df = df.filter(F.lower(c(name).cast("string")).contains(needle.lower()))
    return df


def page(df: DataFrame, order: str, descending: bool = False, number: int = 1, size: int = 50,
         tiebreak: Sequence[str] = ()) -> DataFrame:
    """One page of a table sorted by a column."""
    key = c(order).desc() if descending else c(order).asc()
    return df.orderBy(key, *[c(x) for x in tiebreak]).offset((number - 1) * size).limit(size)


def write_pages(df: DataFrame, path: str, order: str, descending: bool = False, tiebreak: Sequence[str] = (), ranges: int | None = None) -> None:
    """Write a table in the order of its pages: a folder per range, and in each row its place there. Without ``ranges`` Spark sets their number.

    A null comes first in ascending and last in descending order, as in ``page``.
    """
    key = c(order).desc() if descending else c(order).asc()
    keys = [key, *[c(x) for x in tiebreak]]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}).write.mode("overwrite").partitionBy("_part").parquet(path)


def page_bounds(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(range, rows before it, rows in it) in order: one entry per range, from the written places alone."""
    counted = spark.read.parquet(path).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
    out, before = [], 0
    for r in sorted(counted):
        out.append((r["_part"], before, r["n"]))
        before += r["n"]
    return out


def read_page(spark: SparkSession, path: str, bounds: Sequence[tuple[int, int, int]], number: int = 1, size: int = 50) -> DataFrame:
    """A page of a written table. Only the ranges that hold its rows are read, and in them only its places; no row before the page is."""
    low, high = (number - 1) * size, number * size
    rows = spark.read.parquet(path)
    wanted = F.lit(False)
    for part, before, n in bounds:
        if before < high and before + n > low:
            wanted = wanted | ((F.col("_part") == part) & F.col("_place").between(low - before, high - before - 1))
    return rows.filter(wanted).orderBy("_part", "_place").drop("_part", "_place")


def first_packets(packets: DataFrame, order: Sequence[str], count: int = 10, condition: Column | None = None) -> DataFrame:
    """The first packets in capture order, optionally only those that match."""
    if condition is not None:
        packets = packets.filter(condition)
    return packets.orderBy(*[c(x) for x in order]).limit(count)


def packet_summary(packets: DataFrame) -> DataFrame:
    """Layers, size and endpoints of packets; a packet without a network layer has no endpoints."""
    has_ip = F.array_contains(F.split("osi_stack", ":"), "ip")
    return packets.withColumns({
        "layers": F.col("osi_stack"),
        "si": F.when(has_ip, F.col("si")),
        "di": F.when(has_ip, F.col("di")),
    })


def high_risk(df: DataFrame, risk: str = "risk_score", above: int = 50) -> DataFrame:
    """F7."""
    return df.filter(c(risk) > above)


def with_flow_id(df: DataFrame, flow_id: str = "network.community_id") -> DataFrame:
    """F8."""
    return df.filter(c(flow_id).isNotNull() & (c(flow_id) != NO_FLOW_ID))


def top_volume(df: DataFrame, volume: str, tiebreak: Sequence[str], count: int) -> DataFrame:
    """The ``count`` rows with the largest volume."""
    return df.orderBy(c(volume).desc_nulls_last(), *[c(x) for x in tiebreak]).limit(count)
