"""Log warehouse, ticket store, geography and platform logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import ipv4_number
from ..functions.columns import c

# Column names of the log warehouse.
WAREHOUSE_COLUMNS = {"id.orig_h": "src_ip", "id_orig_h": "src_ip", "id.resp_h": "dst_ip", "id_resp_h": "dst_ip"}


def log_tables(spark: SparkSession, names: Sequence[str], database: str | None = None,
               columns: Mapping[str, str] = WAREHOUSE_COLUMNS) -> dict[str, DataFrame]:
    """The log tables that exist, by type, with their columns renamed.

    What a table lacks is decided on its column list, so no predicate on an absent column is made.
    """
    found = {}
    for name in names:
        table = f"{database}.{name}" if database else name
        if spark.catalog.tableExists(table):
            found[name] = spark.table(table).withColumnsRenamed(dict(columns))
    return found


def ticket_by_id(tickets: DataFrame, ticket_id: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """One ticket; a missing outcome is ``Unset``."""
    named = tickets.withColumnsRenamed(dict(columns or {}))
    return named.filter(F.col("ticket_id") == ticket_id).withColumn("outcome", F.coalesce("outcome", F.lit("Unset")))


def indicator_by_value(iocs: DataFrame, ioc_type: str, value: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    named = iocs.withColumnsRenamed(dict(columns or {}))
    return named.filter((F.col("ioc_type") == ioc_type) & (F.col("ioc_value") == value))


def ids_results_of_ticket(results: DataFrame, ticket_id: str) -> DataFrame:
    return results.filter(F.col("ticket_id") == ticket_id)


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; give partitionColumn, lowerBound, upperBound and numPartitions for a large one."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def geo_blocks(blocks: DataFrame, locations: DataFrame) -> DataFrame:
    """Address ranges with country from the two geography tables."""
    place = F.coalesce(c("geoname_id").try_cast("long"), c("registered_country_geoname_id").try_cast("long"))
    parts = F.split("network", "/")
    size = F.pow(F.lit(2.0), F.lit(32) - parts[1].cast("int")).cast("long")
    first = ipv4_number(parts[0])
    low = first - first % size
    ranges = blocks.select(low.alias("lo"), (low + size - 1).alias("hi"), place.alias("_place"))
    named = locations.select(c("geoname_id").try_cast("long").alias("_place"), F.col("country_iso_code").alias("country_code"), "country_name")
    return ranges.join(named, "_place", "left").select("lo", "hi", "country_code", "country_name")


def read_geo(spark: SparkSession, blocks_path: str, locations_path: str) -> DataFrame:
    read = spark.read.option("header", True)
    return geo_blocks(read.csv(blocks_path), read.csv(locations_path))


def read_platform_log(spark: SparkSession, path: str, last: int = 50, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """The newest records of a JSON-lines log."""
    return newest(spark.read.json(path), last, order)


def newest(records: DataFrame, last: int, order: Sequence[str]) -> DataFrame:
    return records.orderBy(*[c(x).desc() for x in order]).limit(last)
