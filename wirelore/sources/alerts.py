"""IDS fast-alert logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import add_flow_id
from ..functions.attack import priority_risk
from ..functions.columns import c
from ..operators.normalize import align

# Fixed value: the line format of fast alerts, one group per field.
ALERT_LINE = (
    r"(\d{2}/\d{2}-\d{2}:\d{2}:\d{2}\.\d+)\s+\[\*\*\] \[(\d+:\d+:\d+)\] (.+?) \[\*\*\] "
    r"(?:\[Classification: (.+?)\] )?\[Priority: (\d+)\] \{(\w+)\} "
    r"([\d.]+)(?::(\d+))? -> ([\d.]+)(?::(\d+))?"
)
FIELDS = "stamp alert_id message classification priority proto src_ip src_port dst_ip dst_port".split()


def parse_alert_lines(lines: DataFrame, year: int) -> DataFrame:
    """Alert fields of the ``value`` lines that have the format; the log has no year, so it is given."""
    matched = lines.filter(F.col("value").rlike(ALERT_LINE))
    raw = matched.select([F.regexp_extract("value", ALERT_LINE, i + 1).alias(f) for i, f in enumerate(FIELDS)])
    parts = F.split("alert_id", ":")
    return raw.select(
        F.try_to_timestamp(F.concat(F.lit(f"{year}-"), "stamp"), F.lit("yyyy-MM/dd-HH:mm:ss.SSSSSS")).alias("ts"),
        "alert_id", parts[0].try_cast("int").alias("gid"), parts[1].try_cast("int").alias("sid"),
        F.trim("message").alias("message"), F.nullif(F.col("classification"), F.lit("")).alias("classification"),
        F.col("priority").try_cast("int").alias("priority"), F.lower("proto").alias("proto"),
        "src_ip", F.col("src_port").try_cast("int").alias("src_port"),
        "dst_ip", F.col("dst_port").try_cast("int").alias("dst_port"))


def read_alerts(spark: SparkSession, path: str, year: int) -> DataFrame:
    return parse_alert_lines(spark.read.text(path), year)


def alerts_as_ecs(alerts: DataFrame) -> DataFrame:
    """Alerts in the ECS shape; an absent port is 0 there."""
    named = alerts.select(
        F.col("ts").alias("@timestamp"), F.col("src_ip").alias("source.ip"),
        F.coalesce("src_port", F.lit(0)).alias("source.port"), F.col("dst_ip").alias("destination.ip"),
        F.coalesce("dst_port", F.lit(0)).alias("destination.port"), F.col("proto").alias("network.transport"),
        F.col("message").alias("alert.message"), "alert_id", F.lit("snort").alias("data.source"),
        F.lit("ids_alert").alias("network.protocol"), priority_risk(F.col("priority").cast("string")).alias("risk_score"))
    return align(add_flow_id(named, "source.ip", "destination.ip", "source.port", "destination.port", "network.transport",
                             "network.community_id"))


SAME_ALERT = ["@timestamp", "alert.message", "source.ip", "destination.ip"]


def merge_engines(*engines: DataFrame) -> DataFrame:
    """Alerts of several engines without repeats (S6); the earliest engine's row is kept."""
    tagged = None
    for i, df in enumerate(engines):
        part = df.withColumn("_engine", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [x for x in tagged.columns if x not in SAME_ALERT and x != "_engine"]
    first = F.min(F.struct("_engine", *[c(x) for x in rest])).alias("_first")
    kept = tagged.groupBy(*[c(x) for x in SAME_ALERT]).agg(first)
    return kept.select([c(x) if x in SAME_ALERT else F.col(f"_first.`{x}`").alias(x) for x in engines[0].columns])
