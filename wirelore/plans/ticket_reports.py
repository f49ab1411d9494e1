"""Ticket reports: every ticket's window, history, techniques, score and advice in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import table_protocol
from ..operators import history, ioc, rules, scoring, window_sweep


def window_features(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one-row-per-window aggregates that the technique rules and the scores read."""
    keys = list(keys)
    log = F.col("log_type")

    def seen(condition) -> F.Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    counts = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sightings"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        *[seen(log == t).alias(f"{t}_sightings") for t in ("dns", "http", "ssl", "smtp", "ssh", "rdp", "telnet")],
        seen(F.col("qtype_name") == "TXT").alias("txt_queries"),
        seen(F.col("qtype_name") == "NULL").alias("null_queries"),
        seen(F.col("rcode_name").isin("NXDOMAIN", "3")).alias("nxdomain"),
        seen(F.col("method") == "POST").alias("post_requests"),
        seen(F.col("method") == "GET").alias("get_requests"),
        F.countDistinct("query").alias("unique_queries"),
        F.countDistinct("user_agent").alias("unique_user_agents"),
        F.countDistinct("ja3").alias("unique_ja3"),
        F.countDistinct("mailfrom").alias("unique_senders"),
        F.countDistinct("rcptto").alias("unique_recipients"),
        F.countDistinct("src_ip").alias("distinct_src_ip_count"),
        F.countDistinct("dst_ip").alias("distinct_dst_ip_count"),
        F.countDistinct("log_type").alias("protocols"),
        F.countDistinct("log_type", "matched_field").alias("coverage"),
        F.array_sort(F.collect_set(table_protocol(log))).alias("protocols_involved"),
        F.array_sort(F.collect_set("matched_field")).alias("matched_fields"),
    )
    details = {"has_dns_details": "dns", "has_http_details": "http", "has_tls_details": "ssl"}
    counts = counts.withColumns({flag: F.col(f"{t}_sightings") > 0 for flag, t in details.items()})
    peers = ioc.peer_concentration(ioc.peer_counts(found, keys), keys).drop("total")
    buckets = ioc.temporal_metrics(ioc.temporal_distribution(found, keys), keys).select(
        *keys, "bucket_count", F.col("avg_per_bucket").alias("bucket_avg"), F.col("variance").alias("bucket_variance"),
        "beaconing_indicator")
    return counts.join(peers, keys, "left").join(buckets, keys, "left")


def ticket_reports(logs: Mapping[str, DataFrame], tickets: DataFrame, hours: int = 24) -> DataFrame:
    """One nested report row per ticket (K9).

    ``tickets`` has ticket_id, created_at, status, severity, outcome, ioc_type, ioc_value and t0. A
    ticket without sightings keeps an empty window. Tickets of one indicator and trigger time share
    a window, which is evaluated once. All of a window's aggregates come from one sweep over trigger
    time, so sightings and windows never meet in pairs.
    """
    window = ["ioc_type", "ioc_value", "t0"]
    distinct_windows = tickets.select(window).distinct()
    near = ioc.within_any_window(logs, distinct_windows, hours)
    features = window_sweep.window_features(ioc.sightings(near, tickets), distinct_windows, hours)
    base = history.history_without_self(tickets)
    joined = rules.map_techniques(base.join(features, window, "left"))
    sightings = F.coalesce("total_sightings", F.lit(0))
    score = scoring.ticket_score(sightings, F.coalesce("protocols", F.lit(0)), F.col("threat_ratio"))
    joined = joined.withColumn("confidence", score)
    half = F.make_dt_interval(hours=F.lit(hours))

    def counted(*names: str) -> list:
        return [F.coalesce(n, F.lit(0)).alias(n) for n in names]

    return joined.select(
        "ticket_id",
        F.struct("created_at", "status", "severity", F.coalesce("outcome", F.lit("Unset")).alias("outcome")).alias("ticket"),
        F.struct(F.col("t0").alias("anchor_t0"), (F.col("t0") - half).alias("start"), (F.col("t0") + half).alias("end"),
                 F.lit(float(2 * hours)).alias("duration_hours")).alias("analysis_window"),
        F.struct("ioc_type", "ioc_value", "matched_fields", "protocols_involved", "first_seen", "last_seen").alias("indicator"),
        F.struct("total_tickets", "threat_count", "false_positive_count", "threat_ratio", "last_observed_ticket").alias("history"),
        F.struct(
            sightings.alias("total_ioc_sightings"), *counted("distinct_src_ip_count", "distinct_dst_ip_count", "coverage"),
            "top1_share", "top3_share", "beaconing_indicator",
        ).alias("current_window"),
        "observed_ttps",
        "confidence",
        scoring.recommended_actions(F.col("confidence.confidence"), F.col("threat_ratio")).alias("recommended_actions"),
    )
