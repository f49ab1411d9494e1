"""Text, threat-intel and report sinks (K6-K9)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import is_ipv4
from ..functions.columns import c
from ..operators import detect, ttp
from ..operators.correlate import correlated_batch, group_text, merge_groups
from ..operators.validate import gate, violations
from ..plans.ticket_reports import ticket_reports
from ..session import cut_lineage


def correlated_groups(fused: DataFrame, bucket_seconds: int = 1) -> DataFrame:
    """Fused sightings as correlation groups; the flow id orders merged facts."""
    rows = correlated_batch(fused, "fused", bucket_seconds).withColumn("ord", c("network.community_id"))
    return merge_groups(rows, "ord")


def export_groups(fused: DataFrame, path: str) -> dict:
    """Validated groups as text below ``path``; an invalid set is refused (K6).

    The groups are written once and then checked and exported from that table.
    """
    groups = cut_lineage(correlated_groups(fused), "groups")
    verdict = gate(groups).first().asDict()
    if verdict["status"] != "VALID":
        first = [f"{v.corr_id} {v.place}: {v.violation}" for v in violations(groups).limit(5).collect()]
        raise ValueError(f"correlation groups are invalid: {verdict['violations']} violations, among them {first}")
    group_text(groups).select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)
    return verdict


def intel_objects(fused: DataFrame, limit: int | None = None) -> DataFrame:
    """Traffic and relationship objects of risky sightings (K7): (object_type, object_id, body).

    Sightings need two addresses, of either IP version, and a byte count. ``limit`` keeps the riskiest.
    """
    address = lambda x: is_ipv4(c(x)) | c(x).contains(":")
    usable = fused.filter((F.col("risk_score") > 0) & address("source.ip") & address("destination.ip") & c("network.bytes").isNotNull())
    if limit is not None:
        usable = usable.orderBy(F.col("risk_score").desc(), c("network.community_id")).limit(limit)
    key = F.md5(c("network.community_id"))
    traffic_id = F.concat(F.lit("network-traffic--"), key)
    traffic = F.to_json(F.struct(
        F.lit("network-traffic").alias("type"), traffic_id.alias("id"),
        F.date_format(c("@timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start"), c("source.ip").alias("src"),
        c("destination.ip").alias("dst"), F.array(c("network.protocol")).alias("protocols"), c("network.bytes").alias("byte_count")))
    link = F.to_json(F.struct(
        F.lit("relationship").alias("type"), F.lit("related-to").alias("relationship_type"), traffic_id.alias("target_ref"),
        F.concat(F.lit("Risk Score: "), F.col("risk_score").cast("string"), F.lit(" | Tools: "), F.col("fused_sources")).alias("description")))
    objects = F.array(
        F.struct(F.lit("network-traffic").alias("object_type"), traffic_id.alias("object_id"), traffic.alias("body")),
        F.struct(F.lit("relationship").alias("object_type"), F.concat(F.lit("relationship--"), key).alias("object_id"), link.alias("body")))
    return usable.select(F.explode(objects).alias("o")).select("o.*")


def export_intel(fused: DataFrame, path: str, limit: int | None = None) -> None:
    intel_objects(fused, limit).select("body").write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Findings:
    """What a report tells of an event set, each written once: techniques of the patterns, and findings of the detectors."""

    techniques: DataFrame
    anomalies: DataFrame


def find(events: DataFrame, **thresholds: dict) -> Findings:
    """Interval and scan metrics are worked out once and serve patterns and detectors, unless a threshold asks for others."""
    own_intervals = {"keys", "min_events"} & thresholds.get("beaconing", {}).keys()
    intervals = None if own_intervals else cut_lineage(detect.interval_metrics(events), "intervals")
    scans = None if "scan_metrics" in thresholds else cut_lineage(detect.scan_metrics(events), "scans")
    techniques = cut_lineage(ttp.techniques_of(ttp.detect_patterns(events, intervals, scans)), "techniques")
    return Findings(techniques, cut_lineage(detect.all_detectors(events, intervals=intervals, scans=scans, **thresholds), "findings"))


def machine_report(events: DataFrame, history: DataFrame | None = None, sample: int = 20, found: Findings | None = None, **thresholds: dict) -> DataFrame:
    """One row: summary, techniques, anomalies, history, and the newest events as a sample (K8).

    Techniques and findings are counted per kind here, with one piece of evidence each; their rows are tables of their
    own. So no list grows with the events.
    """
    found = find(events, **thresholds) if found is None else found
    kinds = ["technique_id", "technique_name", "tactic", "confidence", "pattern"]
    per_kind = found.techniques.groupBy(*kinds).agg(F.count(F.lit(1)).alias("sightings"), F.min("evidence").alias("evidence"))
    ttp_list = per_kind.agg(F.array_sort(F.collect_list(F.struct(*kinds, "sightings", "evidence")))).scalar()
    finding_list = found.anomalies.groupBy("category", "confidence").agg(F.count(F.lit(1)).alias("findings")).agg(
        F.array_sort(F.collect_list(F.struct("category", "confidence", "findings"))).alias("a")).scalar()
    newest = events.orderBy(F.col("t").desc(), "si", "di", "pr").limit(sample)
    shown = newest.agg(F.reverse(F.array_sort(F.collect_list(F.struct(
        F.col("t").alias("timestamp"), F.col("si").alias("src"), F.col("di").alias("dst"), F.col("pr").alias("protocol"),
        "dns_query", "http_host", "tls_sni"))))).scalar()
    past = F.lit(None).cast("struct<total_tickets:bigint>") if history is None else history.agg(F.first(F.struct("*"))).scalar()
    base = events.sparkSession.range(1).select(
        events.agg(F.count(F.lit(1))).scalar().alias("total_events"), found.techniques.agg(F.count(F.lit(1))).scalar().alias("ttps_detected"), found.anomalies.agg(F.count(F.lit(1))).scalar().alias("anomalies_found"),
        ttp_list.alias("ttps"), finding_list.alias("anomalies"), past.alias("historical_stats"), shown.alias("events_sample"))
    return base.select(
        F.struct("total_events", "ttps_detected", "anomalies_found").alias("summary"),
        "ttps", "anomalies", "historical_stats", "events_sample")


def export_machine_report(events: DataFrame, path: str, history: DataFrame | None = None, sample: int = 20, **thresholds: dict) -> None:
    """The report as one row, and next to it every technique and every finding."""
    found = find(events, **thresholds)
    machine_report(events, history, sample, found).write.mode("overwrite").json(path)
    found.techniques.write.mode("overwrite").json(f"{path.rstrip('/')}-techniques")
    found.anomalies.write.mode("overwrite").json(f"{path.rstrip('/')}-findings")


def export_ticket_reports(logs: Mapping[str, DataFrame], tickets: DataFrame, path: str, hours: int = 24) -> None:
    """All tickets' reports as JSON lines in one job (K9)."""
    ticket_reports(logs, tickets, hours).write.mode("overwrite").json(path)
