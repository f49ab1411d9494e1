"""Filters, plain aggregates, history, scores and report metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import attack
from ..operators import filters, history, scoring, summary
from .core import query
from .views import view

EVENT_COLUMNS = ["event_id", "t", "si", "di", "pr"]


# --- filters ---------------------------------------------------------------------------------

@query("event_query", ids="F1", views="v_events", sql="""
    select event_id, t, si, di, pr from v_events where t >= 1704500000 and t <= 1706000000 and si = '10.0.0.7'
      and pr = 'http'""")
def event_query(spark, sf):
    found = filters.query_events(view(spark, sf, "v_events"), start=1704500000, end=1706000000, src="10.0.0.7",
                                 protocol="HTTP", tiebreak=["event_id"])
    return found.select(EVENT_COLUMNS)


@query("event_query_newest", ids="F1", views="v_events", sql="""
    select event_id, t, si, di, pr from v_events""")
def event_query_newest(spark, sf):
    return filters.query_events(view(spark, sf, "v_events"), tiebreak=["event_id"]).select(EVENT_COLUMNS)


@query("window_around_time", ids="F3", views="v_events", sql="""
    select event_id, ts, si from v_events where ts between timestamp '2024-01-14 12:00:00' and timestamp '2024-01-16 12:00:00'""")
def window_around_time(spark, sf):
    return filters.around(view(spark, sf, "v_events"), "ts", datetime(2024, 1, 15, 12), 24).select("event_id", "ts", "si")


@query("table_search", ids="F4", views="v_events", sql="""
    select event_id, si, alert_msg from v_events where contains(lower(alert_msg), 'scan') and contains(lower(si), '.1')""")
def table_search(spark, sf):
    found = filters.search(view(spark, sf, "v_events"), {"alert_msg": "SCAN", "si": ".1", "di": ""})
    return found.select("event_id", "si", "alert_msg")


@query("table_page", ids="F5", views="v_events", sql="""
    select event_id, bytes_sent from v_events order by bytes_sent desc, event_id limit 50 offset 100""")
def table_page(spark, sf):
    paged = filters.page(view(spark, sf, "v_events"), "bytes_sent", descending=True, number=3, tiebreak=["event_id"])
    return paged.select("event_id", "bytes_sent")


@query("first_packets", ids="F6", views="v_events", sql="""
    select event_id, ts, osi_stack as layers, bytes_sent, si, di from v_events where pr = 'dns' order by t, event_id limit 25""")
def first_packets(spark, sf):
    packets = filters.first_packets(view(spark, sf, "v_events"), ["t", "event_id"], 25, F.col("pr") == "dns")
    return filters.packet_summary(packets).select("event_id", "ts", "layers", "bytes_sent", "si", "di")


@query("high_risk_events", ids="F7", views="v_flows", sql="""
    select si, di, dp, risk_score, count(*) as flows from v_flows where risk_score > 50 group by all""")
def high_risk_events(spark, sf):
    risky = filters.high_risk(view(spark, sf, "v_flows"))
    return risky.groupBy("si", "di", "dp", "risk_score").agg(F.count("*").alias("flows"))


@query("fusable_events", ids="F8", views="v_events", sql="""
    select event_id, community_id from v_events where pr <> 'icmp' and community_id is not null""")
def fusable_events(spark, sf):
    rows = view(spark, sf, "v_events").withColumn(
        "community_id", F.when(F.col("pr") == "icmp", "none").otherwise(F.col("community_id")))
    return filters.with_flow_id(rows, "community_id").select("event_id", "community_id")


@query("top_volume_tenth", ids="F9", views="v_events", sql="""
    select event_id, bytes_sent from (select *, row_number() over (order by bytes_sent desc, event_id) as rn,
      count(*) over () as n from v_events) where rn <= n // 10 + 1""")
def top_volume_tenth(spark, sf):
    rows = view(spark, sf, "v_events").select("event_id", "bytes_sent")
    return filters.top_volume(rows, "bytes_sent", ["event_id"], rows.count() // 10 + 1)


@query("top_volume_500", ids="F9", views="v_events", sql="""
    select event_id, bytes_sent from v_events order by bytes_sent desc, event_id limit 500""")
def top_volume_500(spark, sf):
    return filters.top_volume(view(spark, sf, "v_events").select("event_id", "bytes_sent"), "bytes_sent", ["event_id"], 500)


# --- event-set summaries ---------------------------------------------------------------------

@query("protocol_distribution", ids="A1", views="v_flows", sql="select pr, count(*) as events from v_flows group by pr")
def protocol_distribution(spark, sf):
    return summary.protocol_distribution(view(spark, sf, "v_flows"))


@query("ioc_history_verdict", ids="A2", views="v_tickets", sql="""
    select ioc_type, ioc_value, count(*) as total_tickets, count(*) filter (verdict = 'MALICIOUS') as tp_count,
      count(*) filter (verdict = 'BENIGN') as fp_count, max(created_at) as last_seen,
      coalesce(count(*) filter (verdict = 'MALICIOUS') / nullif(count(*) filter (verdict in ('MALICIOUS', 'BENIGN')), 0), 0.5) as threat_ratio
    from v_tickets group by all""")
def ioc_history_verdict(spark, sf):
    return history.verdict_history(view(spark, sf, "v_tickets"))


@query("ioc_history_outcome", ids="A3", views="v_tickets", sql="""
    select ioc_type, ioc_value, count(*) as total_tickets, count(*) filter (outcome = 'Threat') as threat_count,
      count(*) filter (outcome = 'False Positive') as false_positive_count,
      round(count(*) filter (outcome = 'Threat') / nullif(count(outcome), 0), 4) as threat_ratio,
      max(created_at) as last_observed_ticket
    from v_tickets group by all""")
def ioc_history_outcome(spark, sf):
    return history.outcome_history(view(spark, sf, "v_tickets"))


@query("ticket_history_without_self", ids="J6", views="v_tickets", sql="""
    select a.ticket_id, count(b.ticket_id) as total_tickets, count(*) filter (b.outcome = 'Threat') as threat_count,
      count(*) filter (b.outcome = 'False Positive') as false_positive_count,
      round(count(*) filter (b.outcome = 'Threat') / nullif(count(b.outcome), 0), 4) as threat_ratio,
      max(b.created_at) as last_observed_ticket
    from v_tickets a left join v_tickets b on a.ioc_type = b.ioc_type and a.ioc_value = b.ioc_value and a.ticket_id <> b.ticket_id
    group by a.ticket_id""")
def ticket_history_without_self(spark, sf):
    return history.history_without_self(view(spark, sf, "v_tickets")).select(
        "ticket_id", "total_tickets", "threat_count", F.col("false_positive_count"), "threat_ratio", "last_observed_ticket")


@query("event_set_summary", ids="A18", views="v_flows", sql="""
    select count(*) as total_events, count(distinct si) as distinct_sources, count(distinct di) as distinct_destinations,
      count(distinct pr) as distinct_protocols from v_flows""")
def event_set_summary(spark, sf):
    return summary.event_set_summary(view(spark, sf, "v_flows"))


@query("primary_indicator", ids="A19", views="v_flows", sql="""
    select 'ip' as ioc_type, di as ioc_value, count(*) as sightings, (select min(t) from v_flows) as window_start,
      (select max(t) from v_flows) as window_end from v_flows group by di order by count(*) desc, di limit 1""")
def primary_indicator(spark, sf):
    return summary.primary_indicator(view(spark, sf, "v_flows"))


@query("report_volume_by_hour", ids="A20", views="v_events", sql="""
    select strftime(ts, '%H:00') as hour, cast(sum(bytes_sent + bytes_recv) as bigint) / 1048576 as megabytes from v_events group by 1""")
def report_volume_by_hour(spark, sf):
    return summary.volume_by_hour(view(spark, sf, "v_events"))


@query("report_top_protocols", ids="A21", views="v_events", sql="""
    select pr, count(*) as events from v_events group by pr order by events desc, pr limit 5""")
def report_top_protocols(spark, sf):
    return summary.top_counts(view(spark, sf, "v_events"), "pr", 5)


@query("report_risk_by_hour", ids="A22", views="v_events", sql="""
    select strftime(ts, '%H:00') as hour, count(*) filter (alert_msg is not null and alert_priority >= 1) as high,
      count(*) filter (alert_msg is not null and alert_priority < 1) as suspicious,
      count(*) filter (alert_msg is null) as normal from v_events group by 1""")
def report_risk_by_hour(spark, sf):
    return summary.risk_by_hour(view(spark, sf, "v_events"))


@query("report_top_talkers", ids="A23", views="v_flows", sql="""
    select si, count(*) as events from v_flows group by si order by events desc, si limit 5""")
def report_top_talkers(spark, sf):
    return summary.top_counts(view(spark, sf, "v_flows"), "si", 5)


@query("report_connection_states", ids="A24", views="v_events", sql="""
    select conn_state, count(*) as events from v_events group by all order by events desc, conn_state limit 5""")
def report_connection_states(spark, sf):
    return summary.top_counts(view(spark, sf, "v_events"), "conn_state", 5)


@query("kpis", ids="A26", views="v_flows", sql="""
    select count(*) as total_events, cast(sum(bytes_sent) as bigint) as total_bytes,
      count(*) filter (risk_score > 50) as high_risk_events, avg(risk_score) as mean_risk, count(distinct si) as unique_sources
    from v_flows""")
def kpis(spark, sf):
    return summary.kpis(view(spark, sf, "v_flows"), "bytes_sent", "risk_score", "si")


# --- report metrics --------------------------------------------------------------------------

@query("peak_activity", ids="R1", views="v_events", sql="""
    with h as (select date_trunc('hour', ts) as b, count(*) as n from v_events group by 1)
    select arg_min(b, (-n, b)) as peak_bucket, max(n) as peak_events, avg(n) as mean_per_hour,
      (avg(n) - 12.0) / 12.0 * 100 as deviation_percent from h""")
def peak_activity(spark, sf):
    hourly = view(spark, sf, "v_events").groupBy(F.date_trunc("hour", "ts").alias("b")).agg(F.count("*").alias("n"))
    return summary.peak_bucket(hourly, "b", "n", hours_per_bucket=1, baseline=12)


@query("protocol_table", ids="R2", views="v_flows", sql="""
    select pr, count(*) as events, count(*) / sum(count(*)) over () * 100 as percentage from v_flows group by pr""")
def protocol_table(spark, sf):
    return summary.protocol_table(view(spark, sf, "v_flows"))


@query("alert_table", ids="R3", views="v_events", sql="""
    select alert_sid, alert_msg, alert_priority, count(*) as alerts from v_events where alert_msg is not null group by all""")
def alert_table(spark, sf):
    alerts = view(spark, sf, "v_events").filter(F.col("alert_msg").isNotNull())
    return summary.counts(alerts, "alert_sid", "alert_msg", "alert_priority", name="alerts")


_INVENTORY = {"dns_query": "domain", "http_host": "domain", "tls_sni": "sni", "tls_ja3": "ja3", "http_uri": "url", "si": "ip", "di": "ip"}


@query("indicator_inventory", ids="R4", views="v_events", sql="""
    with x as (""" + " union all ".join(
        f"select '{k}' as indicator_type, {n} as indicator_value, t, data_source from v_events" for n, k in _INVENTORY.items()) + """)
    select indicator_type, indicator_value, min(t) as first_seen, max(t) as last_seen, count(*) as sightings,
      array_to_string(list_sort(list_distinct(list(data_source))), ', ') as sources
    from x where indicator_value is not null group by all""")
def indicator_inventory(spark, sf):
    return summary.indicator_inventory(view(spark, sf, "v_events"), _INVENTORY, "t", "data_source")


@query("record_counts", ids="R5", views="v_events", sql="""
    select count(*) as flows, count(dns_query) as dns, count(*) filter (pr = 'tls') as tls, count(http_method) as http,
      count(alert_msg) as ids from v_events""")
def record_counts(spark, sf):
    return summary.record_counts(view(spark, sf, "v_events"))


_FIELDS = ["si", "sp", "di", "dp", "dns_query", "http_host", "tls_sni", "alert_msg"]


@query("field_completeness", ids="R6", views="v_events", sql=" union all ".join(
    f"select '{x}' as field, count({x}) as filled, count({x}) / count(*) as completeness from v_events" for x in _FIELDS))
def field_completeness(spark, sf):
    return summary.field_completeness(view(spark, sf, "v_events"), _FIELDS)


@query("dashboard_cards", ids="R7", views="v_flows", sql="""
    select count(*) as events, count(distinct si) as unique_sources,
      count(distinct si) filter (risk_score > 50) as high_risk_actors, cast(sum(bytes_sent) as bigint) / 1e9 as volume_gb from v_flows""")
def dashboard_cards(spark, sf):
    return summary.dashboard_cards(view(spark, sf, "v_flows"), "bytes_sent", "risk_score", "si")


@query("evidence_index", ids="R9", views="v_events", sql="""
    select * from (select pr as category, row_number() over (partition by pr order by event_id) as position,
      event_id as ref from v_events) where position <= 20""")
def evidence_index(spark, sf):
    return summary.evidence_index(view(spark, sf, "v_events"), F.col("pr"), "event_id", 20).withColumn(
        "position", F.col("position").cast("long"))


@query("severity_badges", ids="R11", views="v_tickets", sql="""
    with x as (select ticket_id, total / 500000 as confidence from v_tickets)
    select ticket_id, case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as badge from x""")
def severity_badges(spark, sf):
    return view(spark, sf, "v_tickets").select(
        "ticket_id", attack.severity_badge(F.col("total") / 500000).alias("badge"))


# --- scores ----------------------------------------------------------------------------------

@query("weighted_scores", ids="W1", views="v_tickets", sql="""
    with h as (select ioc_value, count(*) filter (verdict = 'MALICIOUS') as tp, count(verdict) as n,
        least(1.0, count(*) / 20.0::double) as cur from v_tickets group by all),
      s as (select ioc_value, 0.75::double * cur + 0.25::double * coalesce(tp / nullif(n, 0), 0.5::double) as score from h)
    select ioc_value, score, case when score >= 0.70 then 'THREAT-CONSISTENT' when score >= 0.40 then 'INCONCLUSIVE'
      else 'FALSE-POSITIVE-CONSISTENT' end as assessment from s""")
def weighted_scores(spark, sf):
    per_ioc = history.verdict_history(view(spark, sf, "v_tickets"))
    score = scoring.weighted_score(scoring.capped(F.col("total_tickets"), 20), F.col("threat_ratio"))
    return per_ioc.select("ioc_value", score.alias("score")).withColumn("assessment", scoring.assessment(F.col("score")))


@query("ticket_scores", ids="W2", views="v_tickets", sql="""
    with h as (select ioc_value, count(*) as n, count(distinct severity) as p,
        round(count(*) filter (outcome = 'Threat') / nullif(count(outcome), 0), 4) as r from v_tickets group by all),
      s as (select ioc_value, 0.75::double * (least(1.0, n / 100) * 0.5::double + least(1.0, p / 3) * 0.5::double)
        + 0.25::double * coalesce(r, 0.5::double) as s from h)
    select ioc_value, s as score, case when s > 0.6 then 'Threat-consistent' when s < 0.4 then 'False-positive-consistent'
      else 'Inconclusive' end as assessment, case when s > 0.75 then 'high' when s > 0.6 then 'medium' when s >= 0.4 then 'low'
      when s > 0.25 then 'medium' else 'high' end as confidence from s""")
def ticket_scores(spark, sf):
    tickets = view(spark, sf, "v_tickets")
    protocols = tickets.groupBy("ioc_value").agg(F.countDistinct("severity").alias("protocols"))
    rows = history.outcome_history(tickets).join(protocols, "ioc_value")
    score = scoring.ticket_score(F.col("total_tickets"), F.col("protocols"), F.col("threat_ratio"))
    return rows.select("ioc_value", score.alias("s")).select("ioc_value", "s.score", "s.assessment", "s.confidence")


@query("recommended_actions", ids="W3", views="v_tickets", sql="""
    select ticket_id, case severity when 'high' then 'Block the IOC at perimeter firewall/proxy; Isolate affected assets for forensic analysis; Notify incident response team'
        when 'medium' then 'Add IOC to monitoring watchlist; Increase logging for involved assets' else '' end as immediate,
      'Correlate with endpoint detection logs; Check for related IOCs in threat intelligence feeds; Validate business justification for observed traffic' as validation,
      case when total / 500000 > 0.5 then 'Update IOC reputation in threat intel platform; ' else '' end
        || 'Document findings in case management system; Update detection rules if new patterns identified' as long_term
    from v_tickets""")
def recommended_actions(spark, sf):
    rows = view(spark, sf, "v_tickets").select(
        "ticket_id", scoring.recommended_actions(F.col("severity"), F.col("total") / 500000).alias("a"))
    return rows.select("ticket_id", *[F.array_join(f"a.{x}", "; ").alias(x) for x in ("immediate", "validation", "long_term")])


@query("current_window_scores", ids="A47", views="v_events", sql="""
    with g as (select si, count(*) as events, count(distinct pr) as protocols, count(alert_msg) as alerts,
        max(cast(bytes_sent > 300000 as int)) = 1 as pattern from v_events group by si),
      s as (select si, least(1.0, events / 100) as volume_score, least(1.0, protocols / 5) as diversity_score,
        case when pattern then 1.0::double else 0.0::double end as pattern_score, least(1.0, alerts / 10) as alert_score from g)
    select *, (volume_score + diversity_score + pattern_score + alert_score) / 4 as current_window_score from s""")
def current_window_scores(spark, sf):
    per_source = view(spark, sf, "v_events").groupBy("si").agg(
        F.count("*").alias("events"), F.countDistinct("pr").alias("protocols"), F.count("alert_msg").alias("alerts"),
        F.max(F.col("bytes_sent") > 300000).alias("pattern"))
    return scoring.current_window_parts(per_source, "events", "protocols", "pattern", "alerts", 100).drop(
        "events", "protocols", "alerts", "pattern")
