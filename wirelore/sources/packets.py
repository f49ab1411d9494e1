"""Packet-field exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.normalize import with_fields
from ..schemas import DEEP_PACKET_FIELDS, PACKET_FIELDS


def read_fields(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A quoted, comma-separated export with a header; every column stays text, absent ones are NULL."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return with_fields(raw, fields)


def read_packet_fields(spark: SparkSession, path: str) -> DataFrame:
    return read_fields(spark, path, PACKET_FIELDS)


def read_deep_packet_fields(spark: SparkSession, path: str) -> DataFrame:
    return read_fields(spark, path, DEEP_PACKET_FIELDS)
