"""Chart ids and the data they show: ``chart_data(id, events)`` on ECS events.

The entries are fixed values: the id, the builder and its arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..operators import charts, detect, summary

BYTES, RISK, SRC, DST = "network.bytes", "risk_score", "source.ip", "destination.ip"
SPORT, DPORT, PROTO = "source.port", "destination.port", "network.protocol"

# id: (aggregate, metric)
SERIES = {
    "TS_002": ("max", RISK), "TS_003": ("mean", "duration"), "TS_004": ("count", None), "TS_006": ("nunique", SRC),
    "TS_007": ("nunique", DST), "TS_008": ("mean", BYTES), "TS_009": ("max", "duration"), "TS_010": ("count", "alert_id"),
    "TS_011": ("nunique", PROTO), "TS_012": ("nunique", DPORT), "TS_013": ("min", BYTES), "TS_015": ("mean", "duration"),
    "TS_016": ("median", RISK), "TS_017": ("nunique", SPORT), "TS_018": ("std", BYTES), "TS_019": ("nunique", "alert_id"),
    "TS_020": ("count", "enrichment"), "Total_Network_Events_Over_Time": ("count", None),
    "Sessions_Count_Over_Time": ("count", SRC), "Bytes_In_vs_Bytes_Out_Over_Time": ("sum", BYTES),
    "T3_EVENT_TIMELINE": ("count", None), "I5_RISK_TREND": ("max", RISK),
}
# id: (column, bins); text columns are counted by value
HISTOGRAMS = {
    "DS_001": (BYTES, 50), "DS_002": ("duration", 50), "DS_003": (RISK, 10), "DS_004": (SPORT, 30), "DS_005": (DPORT, 30),
    "DS_006": (PROTO, 20), "DS_007": (BYTES, 40), "DS_008": ("duration", 30), "DS_009": (RISK, 20), "DS_010": (BYTES, 60),
    "DS_011": (SPORT, 50), "DS_012": (DPORT, 25), "DS_013": ("duration", 35), "DS_015": (RISK, 15),
    "Protocol_Frequency_Distribution": (PROTO, 50), "Session_Duration_Distribution": ("duration", 50),
    "C6_RISK_DISTRIBUTION": (RISK, 50),
}
# id: (category, metric, aggregate, rows)
RANKINGS = {
    "RK_001": (SRC, BYTES, "sum", 10), "RK_002": (DST, BYTES, "sum", 10), "RK_003": (DPORT, None, "sum", 10),
    "RK_005": (SRC, None, "sum", 10), "RK_006": (DST, None, "sum", 10), "RK_007": (SRC, RISK, "max", 10),
    "RK_008": (DST, RISK, "max", 10), "RK_009": (PROTO, None, "sum", 15), "RK_010": ("network.transport", BYTES, "sum", 10),
    "RK_011": (SPORT, BYTES, "sum", 15), "RK_012": (DPORT, BYTES, "sum", 15), "RK_013": (SRC, "duration", "max", 10),
    "RK_014": (DST, "duration", "max", 10), "RK_015": (PROTO, RISK, "max", 12),
    "ST_011": ("dns.question.name", BYTES, "sum", 10), "ST_003": ("url.domain", BYTES, "sum", 10),
    "Top_Protocols_By_Volume": (PROTO, BYTES, "sum", 10), "Top_Snort_SIDs": ("alert.message", None, "sum", 10),
    "T4_ALERT_SUMMARY": ("alert.message", None, "sum", 10), "A1_TOP_SOURCES": (SRC, BYTES, "sum", 10),
    "A2_TOP_DESTINATIONS": (DST, BYTES, "sum", 10), "C1_PORT_ANALYSIS": (DPORT, None, "sum", 10),
    "C3_TCP_FLAGS": ("tcp.flags", None, "sum", 10), "C4_DNS_TUNNELING": ("dns.question.name", BYTES, "sum", 10),
    "C5_HTTP_HOSTS": ("url.domain", BYTES, "sum", 10),
}
# id: columns
POINTS = {
    "SC_001": (BYTES, "duration", RISK), "SC_002": (BYTES, RISK), "SC_003": ("duration", RISK), "SC_004": (SPORT, DPORT, PROTO),
    "SC_005": (BYTES, RISK), "SC_006": ("duration", BYTES, PROTO), "SC_007": (RISK, BYTES), "SC_008": (SPORT, BYTES, RISK),
    "SC_009": (DPORT, "duration"), "SC_010": (RISK, "duration"), "SC_011": (charts.TS, DPORT, PROTO, BYTES),
    "FI_001": (charts.TS, RISK), "I6_MITRE_TIMELINE": (charts.TS, RISK), "ST_012": (charts.TS, DST),
    "LG_004": (SRC, DPORT, PROTO, BYTES), "I3_MULTI_TRACE": (SRC, DPORT, PROTO, BYTES),
    "LG_009": ("duration", BYTES, DPORT, RISK, PROTO), "I2_TRAFFIC_VS_RISK": (BYTES, RISK),
}
# id: (source, target, weight, nodes)
GRAPHS = {
    "NG_001": (SRC, DST, BYTES, 30), "NG_002": (SRC, DPORT, None, 40), "NG_004": (SRC, DST, BYTES, 50),
    "Source_Destination_Network_Graph": (SRC, DST, None, 50), "A3_NETWORK_MAP": (SRC, DST, BYTES, 50),
}
# id: (metric, aggregate) per country of the enriched event
GEO = {"GM_001": (BYTES, "sum"), "GM_002": (RISK, "max"), "GM_003": (None, "count"), "A4_GEO_ORIGIN": (BYTES, "sum")}


def _distribution(df: DataFrame, column: str, bins: int) -> DataFrame:
    numeric = dict(df.dtypes)[column] in ("int", "bigint", "double", "float")
    return charts.histogram(df, column, bins) if numeric else charts.category_counts(df, column)


def _kpi(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: summary.kpis(df, BYTES, RISK, SRC).select(name)


def _by_country(df: DataFrame, metric: str | None, agg: str) -> DataFrame:
    country = F.get_json_object("enrichment", "$.country")
    value = F.count(F.lit(1)) if metric is None else {"sum": F.sum, "max": F.max}[agg](c(metric))
    return df.groupBy(country.alias("country")).agg(value.alias("value"))


def _catalog() -> dict[str, Callable[[DataFrame], DataFrame]]:
    out: dict[str, Callable[[DataFrame], DataFrame]] = {}
    for cid, spec in SERIES.items():
        out[cid] = lambda df, spec=spec: charts.time_series(df, {"value": spec})
    for cid, spec in HISTOGRAMS.items():
        out[cid] = lambda df, spec=spec: _distribution(df, *spec)
    for cid, (category, metric, agg, rows) in RANKINGS.items():
        out[cid] = lambda df, a=(category, metric, agg, rows): charts.ranking(df, a[0], a[1], a[2], a[3])
    for cid, spec in POINTS.items():
        out[cid] = lambda df, spec=spec: charts.points(df, spec)
    for cid, spec in GRAPHS.items():
        out[cid] = lambda df, spec=spec: charts.network_edges(df, *spec)
    for cid, spec in GEO.items():
        out[cid] = lambda df, spec=spec: _by_country(df, *spec)
    path = ["network.transport", "osi_stack", DPORT]
    out.update({
        "TS_001": lambda df: charts.bandwidth(df),
        "TS_005": lambda df: charts.time_series(df, {"value": ("sum", BYTES)}),
        "NG_003": lambda df: charts.network_edges(df, SRC, DST, BYTES, 25),
        "IN_001": _kpi("total_events"), "IN_002": _kpi("total_bytes"), "IN_003": _kpi("high_risk_events"),
        "IN_004": _kpi("mean_risk"), "IN_005": _kpi("unique_sources"),
        "T1_TOTAL_EVENTS": _kpi("total_events"), "T2_HIGH_RISK_COUNT": _kpi("high_risk_events"),
        "OSI_001": charts.layer_timeline, "OSI_002": charts.layer_distribution, "OSI_003": charts.top_identities,
        "ST_001": lambda df: charts.ranking(df, "osi_stack"),
        "ST_004": charts.week_heatmap, "S4_TEMPORAL_HEATMAP": charts.week_heatmap,
        "ST_005": lambda df: charts.density(df, DPORT, BYTES),
        "ST_006": lambda df: charts.category_volume(df, PROTO, BYTES),
        "LG_001": lambda df: charts.hierarchy(df, path, BYTES),
        "I1_PROTOCOL_STACK": lambda df: charts.hierarchy(df, ["network.transport", PROTO], BYTES),
        "LG_002": lambda df: charts.shares(df, PROTO), "C2_PROTOCOL_MIX": lambda df: charts.shares(df, PROTO),
        "LG_003": lambda df: charts.sankey_links(df, SRC, DST), "I4_DATA_FLOW": lambda df: charts.sankey_links(df, SRC, DST),
        "LG_005": lambda df: charts.port_radar(df),
        "LG_006": lambda df: detect.outliers(df.select(c(charts.TS), c(BYTES), c(RISK))),
        "S1_DNS_ENTROPY": lambda df: charts.entropy_series(df, "dns.question.name"),
        "S2_BEACONING_ANALYSIS": lambda df: detect.time_gaps(
            df.select(F.unix_micros(c(charts.TS).cast("timestamp")).alias("us")).select((F.col("us") / 1e6).alias("t"))),
        "S3_FLOW_ASYMMETRY": lambda df: charts.flow_asymmetry(df, SRC, BYTES),
    })
    return out


CATALOG = _catalog()


def chart_data(chart_id: str, events: DataFrame) -> DataFrame:
    """The rows behind one chart."""
    if chart_id not in CATALOG:
        raise KeyError(f"unknown chart {chart_id}")
    return CATALOG[chart_id](events)
