"""CSV, JSON and Parquet of unknown layout."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import c
from ..operators.normalize import align
from .sessions import read_sessions_as_ecs, session_files

# Header words of the ECS fields.
ALIASES = {
    "@timestamp": ["ts", "time", "date", "datetime", "event_time", "frame.time_epoch", "start"],
    "source.ip": ["src", "src_ip", "client_ip", "orig_h", "source", "ip_src", "clienthost", "client"],
    "destination.ip": ["dst", "dst_ip", "server_ip", "resp_h", "destination", "ip_dst", "targetserver", "target"],
    "source.port": ["sport", "src_port", "client_port", "orig_p", "source_port"],
    "destination.port": ["dport", "dst_port", "server_port", "resp_p", "destination_port"],
    "network.transport": ["proto", "protocol", "transport", "prototype"],
    "network.bytes": ["bytes", "size", "length", "orig_bytes", "resp_bytes", "octets", "traffic"],
}


def _plain(name: str) -> str:
    return re.sub(r"[_. ]", "", name.lower())


def map_headers(columns: Sequence[str]) -> dict[str, str]:
    """Column to ECS name by header: exact words first, then words contained in the header."""
    mapping: dict[str, str] = {}
    for matches in (lambda alias, header: alias == header, lambda alias, header: alias in header):
        for ecs, aliases in ALIASES.items():
            if ecs in mapping.values():
                continue
            words = {_plain(a) for a in [*aliases, ecs]}
            hit = next((x for x in columns if x not in mapping and any(matches(w, _plain(x)) for w in words)), None)
            if hit is not None:
                mapping[hit] = ecs
    return mapping


def discover(df: DataFrame) -> dict[str, str]:
    """Header words, then content (P9): a column whose values are all dotted quads holds addresses, one whose values are
    all small numbers holds ports. All values are tested, in one aggregate."""
    mapping = map_headers(df.columns)
    open_columns = [x for x in df.columns if x not in mapping]
    if not open_columns:
        return mapping
    text = {x: c(x).cast("string") for x in open_columns}
    number = {x: text[x].try_cast("double") for x in open_columns}
    counts = []
    for i, x in enumerate(open_columns):
        counts += [F.count(c(x)).alias(f"n{i}"), F.count_if(text[x].rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).alias(f"ip{i}"), F.count_if(number[x].between(0, 65535)).alias(f"port{i}")]
    row = df.agg(*counts).first()
    for kind, targets in (("ip", ("source.ip", "destination.ip")), ("port", ("source.port", "destination.port"))):
        for i, name in enumerate(open_columns):
            free = [x for x in targets if x not in mapping.values()]
            if free and name not in mapping and row[f"n{i}"] and row[f"{kind}{i}"] == row[f"n{i}"]:
                mapping[name] = free[0]
    return mapping


def _as_events(raw: DataFrame, tag: str, default_risk: int) -> DataFrame:
    named = raw.withColumnsRenamed(discover(raw))
    if "@timestamp" not in named.columns:
        named = named.withColumn("@timestamp", F.current_timestamp())
    else:
        stamp = c("@timestamp").cast("string")
        number = stamp.try_cast("double")
        seconds = F.timestamp_micros((number * 1e6).cast("long"))
        named = named.withColumn("@timestamp", F.when(number.isNotNull(), seconds).otherwise(F.try_to_timestamp(stamp)))
    if "risk_score" not in named.columns:
        named = named.withColumn("risk_score", F.lit(default_risk))
    return align(named.withColumn("data.source", F.lit(tag)))


def read_unknown_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S7."""
    return _as_events(spark.read.option("header", True).csv(path), "csv_mystery", default_risk=0)


def read_unknown_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or one array with ``multi_line``."""
    return _as_events(spark.read.option("multiLine", multi_line).json(path), "json_mystery", default_risk=10)


def load_parquet(spark: SparkSession, path: str, table_path: str, append: bool = False) -> DataFrame:
    """Replace or extend an event table with the rows of a Parquet file."""
    spark.read.parquet(path).write.mode("append" if append else "overwrite").parquet(table_path)
    return spark.read.parquet(table_path)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Read files by their extension (S10). Files of a ``.log`` path are told apart one by one: session logs, or unknown CSV."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_unknown_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "ndjson"):
        return read_unknown_json(spark, path)
    if kind == "log":
        session, other = session_files(spark, path)
        parts = [read_sessions_as_ecs(spark, session)] if session else []
        parts += [read_unknown_csv(spark, other or path)] if other or not session else []
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    raise ValueError(f"unsupported file format: {kind}")
