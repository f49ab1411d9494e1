"""Detectors, pattern and rule based technique mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect
from .core import query
from .views import view

_GAPS = """
    with g as (select {key}, t - lag(t) over (partition by {key} order by t) as gap from {src} where si is not null and di is not null),
      k as (select {key}, round_even(gap, 0) as second, count(*) as k from g where gap is not null group by all),
      e as (select {key}, log2(sum(k)) - sum(k * log2(k)) / sum(k) as entropy from k group by all),
      s as (select {key}, count(gap) as intervals, avg(gap) as m, stddev_pop(gap) as sd from g group by all having count(*) >= 5),
      c as (select *, case when m > 0 then sd / m else 1 end as cv from s join e using ({key}))"""


@query("beaconing_metrics", ids="D1", views="v_events", sql=_GAPS.format(key="si, di, dp", src="v_events") + """
    select si, di, dp, intervals, intervals + 1 as events, round(m, 4) as interval_avg, round(sd, 4) as interval_stddev, round(cv, 6) as cv,
      round(entropy, 6) + 0.0 as entropy, case when cv < 0.05 then 'HIGH' else 'MEDIUM' end as confidence,
      cv < 0.1 and entropy < 1.5 and m > 1 and m < 3600 as flagged from c""")
def beaconing_metrics(spark, sf):
    found = detect.beaconing(view(spark, sf, "v_events"))
    return _rounded_intervals(found)


def _rounded_intervals(found):
    digits = {"interval_avg": 4, "interval_stddev": 4, "cv": 6, "entropy": 6}
    return found.withColumns({k: F.round(k, v) for k, v in digits.items()})


@query("beaconing_by_pair", ids="D1", views="v_flows", sql=_GAPS.format(key="si, di", src="v_flows") + """
    select si, di, intervals, intervals + 1 as events, round(m, 4) as interval_avg, round(sd, 4) as interval_stddev, round(cv, 6) as cv,
      round(entropy, 6) + 0.0 as entropy, case when cv < 0.05 then 'HIGH' else 'MEDIUM' end as confidence,
      cv < 0.4 and entropy < 3 and m > 1 and m < 1e9 as flagged from c""")
def beaconing_by_pair(spark, sf):
    found = detect.beaconing(view(spark, sf, "v_flows"), ("si", "di"), max_cv=0.4, max_entropy=3, max_interval=1e9)
    return _rounded_intervals(found)


@query("dns_tunnel_queries", ids="D2", views="v_names", sql="""
    with ch as (select page_id, url, unnest(string_split(url, '')) as c from v_names),
      k as (select page_id, url, c, count(*) as n from ch group by all),
      e as (select page_id, url, -sum(n / length(url) * log2(n / length(url))) as entropy from k group by all)
    select page_id, si, case when length(url) > 60 then substring(url, 1, 60) || '...' else url end as query,
      cast(length(url) as int) as query_length, round(entropy, 6) as entropy, case when entropy > 4.0 then 'HIGH' else 'MEDIUM' end as confidence,
      length(url) > 45 and entropy > 3.5 as flagged
    from e join v_names using (page_id, url)""")
def dns_tunnel_queries(spark, sf):
    names = view(spark, sf, "v_names").withColumns({"pr": F.lit("dns"), "dns_query": F.col("url")})
    found = detect.dns_tunnel_queries(names, min_length=45)
    return found.select("page_id", "si", "query", "query_length", F.round("entropy", 6).alias("entropy"), "confidence", "flagged")


@query("dns_excess", ids="D3", views="v_names", sql="""
    select list_extract(string_split(host, '.'), -2) as domain, count(*) as query_count, count(*) > 20 as flagged from v_names group by 1""")
def dns_excess(spark, sf):
    return detect.dns_excess(view(spark, sf, "v_names").withColumns({"pr": F.lit("dns"), "dns_query": F.col("host")}))


_SCAN = """
    with s as (select si, count(distinct dp) as unique_ports, count(distinct di) as unique_destinations, count(*) as connections,
        max(t) - min(t) as duration from {src} where si is not null and di is not null group by si)
    select *, case when duration > 0 then connections / duration else 0 end as rate_per_second,
      case when unique_ports > {p} then 'port_scan' when unique_destinations > {d} then 'network_scan' end as type,
      case when unique_ports > {p} and unique_ports > 50 then 'HIGH' else 'MEDIUM' end as confidence,
      unique_ports > {p} or unique_destinations > {d} as flagged from s"""


@query("port_scan_metrics", ids="D4", views="v_events", sql=_SCAN.format(src="v_events", p=20, d=15))
def port_scan_metrics(spark, sf):
    return detect.scan_metrics(view(spark, sf, "v_events"))


@query("network_scan_metrics", ids="D5", views="v_flows", sql=_SCAN.format(src="v_flows", p=20, d=15))
def network_scan_metrics(spark, sf):
    return detect.scan_metrics(view(spark, sf, "v_flows"))


@query("large_transfers", ids="D6", views="v_flows", sql="""
    with s as (select si, di, dp, cast(sum(bytes_sent) as bigint) as bytes_sent, cast(sum(bytes_recv) as bigint) as bytes_recv,
        count(*) as packets from v_flows group by all)
    select *, bytes_sent + bytes_recv as total_bytes, bytes_sent + bytes_recv > 100000 as flagged from s""")
def large_transfers(spark, sf):
    return detect.large_transfers(view(spark, sf, "v_flows"), threshold=100_000)


@query("icmp_excess", ids="D7", views="v_events", sql="""
    with s as (select count(*) filter (pr = 'icmp') as n, count(*) as total from v_events)
    select 'icmp' as protocol, n as count, n / total * 100 as percentage, n > 10 and n / total > 0.05 as flagged from s""")
def icmp_excess(spark, sf):
    return detect.protocol_excess(view(spark, sf, "v_events"))


@query("all_detectors", ids="D8", views="v_events", sql=_GAPS.format(key="si, di, dp", src="v_events").replace("with g as", "with b as (select 1), g as") + """,
      scans as (select si, count(distinct dp) as p, count(distinct di) as d from v_events group by si),
      volumes as (select si, di, dp, cast(sum(bytes_sent + bytes_recv) as bigint) as total from v_events group by all),
      labels as (select list_extract(string_split(dns_query, '.'), -2) as domain, count(*) as n from v_events where pr = 'dns' group by 1)
    select 'beaconing' as category, concat(si, '->', di, ':', dp) as subject, round(cv, 6) as metric,
      case when cv < 0.05 then 'HIGH' else 'MEDIUM' end as confidence from c where cv < 0.3 and entropy < 9 and m > 1 and m < 1e7
    union all select 'port_scans', si, greatest(p, d), case when p > 50 then 'HIGH' else 'MEDIUM' end from scans where p > 20 or d > 15
    union all select 'volume_anomalies', concat(si, '->', di, ':', dp), total, 'MEDIUM' from volumes where total > 300000
    union all select 'dns_tunneling', domain, n, 'MEDIUM' from labels where n > 20
    union all select 'protocol_anomalies', 'icmp', round(count(*) filter (pr = 'icmp') / count(*) * 100, 6), 'MEDIUM' from v_events
      having count(*) filter (pr = 'icmp') > 10 and count(*) filter (pr = 'icmp') / count(*) > 0.05""")
def all_detectors(spark, sf):
    found = detect.all_detectors(
        view(spark, sf, "v_events"), beaconing={"max_cv": 0.3, "max_entropy": 9, "max_interval": 1e7},
        large_transfers={"threshold": 300_000})
    return found.withColumn("metric", F.round("metric", 6))


@query("statistical_outliers", ids="D9", views="v_events", sql="""
    with s as (select avg(bytes_sent) as vm, stddev_samp(bytes_sent) as vs, avg(risk_score) as rm, stddev_samp(risk_score) as rs from v_events),
      z as (select event_id, bytes_sent, risk_score, (bytes_sent - vm) / vs as zb, (risk_score - rm) / rs as zr from v_events, s)
    select event_id, bytes_sent, risk_score, round(zb, 6) as z_score_bytes, round(zr, 6) as z_score_risk,
      coalesce(nullif(concat_ws(', ', case when zb > 3 then 'Volume Outlier (Large)' end, case when zb < -3 then 'Volume Outlier (Tiny)' end,
        case when zr > 3 then 'Statistical Risk Outlier' end, case when risk_score >= 90 then 'Critical Risk Signature' end), ''), 'Minor Deviation') as anomaly_type,
      abs(zb) > 3 or abs(zr) > 3 or risk_score >= 90 as flagged from z""")
def statistical_outliers(spark, sf):
    found = detect.outliers(view(spark, sf, "v_events").select("event_id", "bytes_sent", "risk_score"), volume="bytes_sent")
    return found.withColumns({x: F.round(x, 6) for x in ("z_score_bytes", "z_score_risk")})


@query("time_gaps", ids="D10", views="v_events", sql="""
    select t, delta from (select t, t - lag(t) over (order by t) as delta from v_events) where delta > 0.1""")
def time_gaps(spark, sf):
    return detect.time_gaps(view(spark, sf, "v_events"))


@query("long_time_gaps", ids="D10", views="v_events", sql="""
    select t, delta from (select t, t - lag(t) over (order by t) as delta from v_events) where delta > 600""")
def long_time_gaps(spark, sf):
    return detect.time_gaps(view(spark, sf, "v_events"), min_gap=600, limit=None, slice_seconds=3600)
