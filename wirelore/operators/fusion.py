"""Fusion of the sightings of several tools into one row per flow id (A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attack import fusion_label
from ..functions.columns import c
from .filters import with_flow_id

# Highest value kept per flow, when the column exists.
CARRIED = [
    "risk_score", "tls.handshake.ja3", "tls.client.server_name", "dns.question.name", "user_agent.original",
    "tcp.analysis.initial_rtt", "tcp.analysis.retransmission",
]


def _joined_set(col: Column) -> Column:
    """Distinct values in order, joined; the set holds tool names or rule ids, not rows."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(col)), ", "), F.lit(""))


def fuse(events: DataFrame) -> DataFrame:
    """One row per flow id.

    Session totals of the session tool win over the summed packets of the packet tool. "Any value"
    columns take the smallest value, so that the result does not depend on row order. Everything
    is a partial aggregate; one shuffle by flow id carries at most one row per flow and map task.
    """
    zeek, tshark = c("data.source") == "zeek", c("data.source") == "tshark"
    protocol, size = c("network.protocol"), c("network.bytes")
    out = [
        F.min(c("@timestamp")).alias("@timestamp"),
        *[F.min(c(x)).alias(x) for x in ("source.ip", "source.port", "destination.ip", "destination.port", "network.transport")],
        F.coalesce(
            F.max(F.when(zeek & (protocol != "-"), protocol)), F.max(F.when(tshark, protocol)), F.lit("unknown")
        ).alias("network.protocol"),
        F.coalesce(F.max(F.when(zeek, size)), F.sum(F.when(tshark, size)), F.max(size)).alias("network.bytes"),
        *[F.max(c(x)).alias(x) for x in CARRIED if x in events.columns],
        _joined_set(c("alert_id")).alias("alert_id"),
        F.coalesce(F.max(F.when(tshark, c("osi_stack"))), F.max(c("osi_stack"))).alias("osi_stack"),
        F.coalesce(F.max(fusion_label(c("alert.message"))), F.lit("None / Benign")).alias("mitre_attack"),
        _joined_set(c("data.source")).alias("fused_sources"),
    ]
    if "_ws.col.info" in events.columns:
        out.append(F.min(c("_ws.col.info")).alias("summary_info"))
    return with_flow_id(events).groupBy(c("network.community_id")).agg(*out)
