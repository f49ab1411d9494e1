"""Data of the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts
from ..plans.chart_catalog import chart_data
from .core import query
from .enrich_queries import ECS_NAMES, ecs_events
from .views import view

SERIES_SQL = """with b as (select *, cast(floor(t / 60) * 60 as bigint) as bucket from v_events),
      a as (select bucket, {aggs} from b group by bucket),
      s as (select unnest(generate_series((select min(bucket) from a), (select max(bucket) from a), 60)) as bucket)
    select s.bucket, {filled} from s left join a using (bucket)"""


def _series_sql(**aggs: str) -> str:
    inner = ", ".join(f"{sql} as {name}" for name, sql in aggs.items())
    return SERIES_SQL.format(aggs=inner, filled=", ".join(f"cast(coalesce({n}, 0) as double) as {n}" for n in aggs))


def flows_as_ecs(spark, sf):
    return view(spark, sf, "v_flows").withColumnsRenamed(ECS_NAMES)


@query("series_sum_mean", ids="A27", views="v_events", sql=_series_sql(
    total="sum(bytes_sent)", mean="sum(duration_x) / count(*)", low="min(bytes_sent)", high="max(risk_score)").replace(
    "sum(duration_x) / count(*)", "avg(bytes_sent)"))
def series_sum_mean(spark, sf):
    b = "network.bytes"
    return charts.time_series(ecs_events(spark, sf), {
        "total": ("sum", b), "mean": ("mean", b), "low": ("min", b), "high": ("max", "risk_score")})


@query("series_count_unique", ids="A27", views="v_events", sql=_series_sql(events="count(*)", sources="count(distinct si)", ports="count(distinct dp)"))
def series_count_unique(spark, sf):
    return charts.time_series(ecs_events(spark, sf), {
        "events": ("count", None), "sources": ("nunique", "source.ip"), "ports": ("nunique", "destination.port")})


@query("series_median_std", ids="A27", views="v_events", sql=_series_sql(median="median(risk_score)", deviation="round(stddev_samp(bytes_sent), 4)"))
def series_median_std(spark, sf):
    found = charts.time_series(ecs_events(spark, sf), {"median": ("median", "risk_score"), "deviation": ("std", "network.bytes")})
    return found.withColumn("deviation", F.round("deviation", 4))


@query("bandwidth_mbps", ids="A28", views="v_events", sql=_series_sql(mbps="sum(bytes_sent) * 8 / (60 * 1e6)"))
def bandwidth_mbps(spark, sf):
    return chart_data("TS_001", ecs_events(spark, sf))


@query("kpi_series", ids="R8", views="v_events", sql=_series_sql(
    total_bytes="sum(bytes_sent)", max_risk="max(risk_score)", events="count(*)", high_risk="sum(cast(risk_score > 50 as int))",
    sources="count(distinct si)", duration="max(duration)"))
def kpi_series(spark, sf):
    events = ecs_events(spark, sf).withColumn("high", (F.col("risk_score") > 50).cast("int"))
    return charts.time_series(events, {
        "total_bytes": ("sum", "network.bytes"), "max_risk": ("max", "risk_score"), "events": ("count", None),
        "high_risk": ("sum", "high"), "sources": ("nunique", "source.ip"), "duration": ("max", "duration")})


@query("coverage_gaps", ids="R6", views="v_events", sql="""
    with b as (select distinct cast(floor(t / 600) as bigint) as b from v_events), s as (select b, lag(b) over (order by b) as p from b)
    select (p + 1) * 600 as gap_start, b * 600 as gap_end, b - p - 1 as missing_buckets from s where b - p > 1""")
def coverage_gaps(spark, sf):
    return charts.coverage_gaps(ecs_events(spark, sf), bucket_seconds=600)


@query("histogram_bytes", ids="A29", views="v_flows", sql="""
    with e as (select min(bytes_sent)::double as lo, max(bytes_sent)::double as hi from v_flows),
      h as (select cast(least(floor((bytes_sent - lo) * 50 / (hi - lo)), 49) as int) as bin, count(*) as events from v_flows, e group by 1)
    select cast(range as int) as bin, coalesce(events, 0) as events from range(50) left join h on bin = range""")
def histogram_bytes(spark, sf):
    return chart_data("DS_001", flows_as_ecs(spark, sf))


@query("histogram_protocol", ids="A29", views="v_flows", sql='select pr as "network.protocol", count(*) as events from v_flows group by pr')
def histogram_protocol(spark, sf):
    return chart_data("DS_006", flows_as_ecs(spark, sf))


@query("ranking_sources_by_bytes", ids="A30", views="v_flows", sql="""
    select si as "source.ip", cast(sum(bytes_sent) as bigint) as value from v_flows group by si order by value desc, si limit 10""")
def ranking_sources_by_bytes(spark, sf):
    return chart_data("RK_001", flows_as_ecs(spark, sf))


@query("ranking_ports", ids="A30", views="v_events", sql="""
    select dp as "destination.port", count(*) as value from v_events group by dp order by value desc, dp limit 10""")
def ranking_ports(spark, sf):
    return chart_data("RK_003", ecs_events(spark, sf))


@query("ranking_peak_risk", ids="A30", views="v_events", sql="""
    select si as "source.ip", max(risk_score) as value from v_events group by si order by value desc, si limit 10""")
def ranking_peak_risk(spark, sf):
    return chart_data("RK_007", ecs_events(spark, sf))


@query("pair_flow_counts", ids="A31", views="v_flows", sql="select si as source, di as target, count(*) as value from v_flows group by all")
def pair_flow_counts(spark, sf):
    return charts.pair_counts(flows_as_ecs(spark, sf), "source.ip", "destination.ip")


@query("protocol_hierarchy", ids="A32", views="v_events", sql="""
    select transport as "network.transport", osi_stack, dp as "destination.port", cast(sum(bytes_sent) as bigint) as total,
      cast(3 - grouping(transport) - grouping(osi_stack) - grouping(dp) as int) as depth
    from v_events group by rollup (transport, osi_stack, dp)""")
def protocol_hierarchy(spark, sf):
    return chart_data("LG_001", ecs_events(spark, sf))


@query("protocol_shares", ids="A33", views="v_flows", sql="""
    select pr as "network.protocol", count(*) as events, count(*) / sum(count(*)) over () as share from v_flows group by pr""")
def protocol_shares(spark, sf):
    return chart_data("LG_002", flows_as_ecs(spark, sf))


@query("week_heatmap", ids="A34", views="v_events", sql="""
    select dayname(ts) as day, cast(hour(ts) as int) as hour, count(*) as events from v_events group by all""")
def week_heatmap(spark, sf):
    return chart_data("ST_004", ecs_events(spark, sf))


@query("port_volume_density", ids="A35", views="v_events", sql="""
    with e as (select min(dp)::double as a, max(dp)::double as b, min(bytes_sent)::double as c, max(bytes_sent)::double as d from v_events)
    select cast(least(floor((dp - a) * 40 / (b - a)), 39) as int) as x_bin, cast(least(floor((bytes_sent - c) * 40 / (d - c)), 39) as int) as y_bin,
      count(*) as events from v_events, e group by 1, 2""")
def port_volume_density(spark, sf):
    return chart_data("ST_005", ecs_events(spark, sf))


@query("protocol_volume", ids="A36", views="v_flows", sql="""
    select pr as "network.protocol", cast(sum(bytes_sent) as bigint) as volume from v_flows group by pr""")
def protocol_volume(spark, sf):
    return chart_data("ST_006", flows_as_ecs(spark, sf))


@query("flow_asymmetry", ids="A37", views="v_flows", sql="""
    select si as "source.ip", cast(sum(bytes_sent) as bigint) as total_bytes, count(bytes_sent) as event_count, avg(bytes_sent) as avg_bytes
    from v_flows group by si order by total_bytes desc, si limit 15""")
def flow_asymmetry(spark, sf):
    return chart_data("S3_FLOW_ASYMMETRY", flows_as_ecs(spark, sf))


@query("name_entropy_series", ids="A38", views="v_events", sql="""
    with n as (select ts, dns_query as text, count(*) as events from v_events where dns_query is not null group by all),
      ch as (select distinct text, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from n),
      k as (select text, c, count(*) as k from ch group by all), e as (select text, -sum(k / length(text) * log2(k / length(text))) as entropy from k group by text)
    select ts, text, events, round(entropy, 6) as entropy from n join e using (text)""")
def name_entropy_series(spark, sf):
    return chart_data("S1_DNS_ENTROPY", ecs_events(spark, sf)).withColumn("entropy", F.round("entropy", 6))


_LAYER = """case when regexp_matches(osi_stack, 'http|dns|tls') then 7 when regexp_matches(osi_stack, 'tcp|udp') then 4 else 3 end"""


@query("layer_timeline", ids="A39", views="v_events", sql=f"""
    select cast(floor(t / 86400) * 86400 as bigint) as bucket, count(*) filter ({_LAYER} = 3) as layer_3,
      count(*) filter ({_LAYER} = 4) as layer_4, count(*) filter ({_LAYER} = 7) as layer_7 from v_events group by 1""")
def layer_timeline(spark, sf):
    return chart_data("OSI_001", ecs_events(spark, sf))


@query("layer_distribution", ids="A40", views="v_events", sql=f"select {_LAYER} as layer, count(*) as events from v_events group by 1")
def layer_distribution(spark, sf):
    return chart_data("OSI_002", ecs_events(spark, sf))


@query("top_identities", ids="A41", views="v_events", sql="""
    with x as (select unnest([dns_query, http_host, tls_sni, user_agent]) as identity from v_events)
    select identity, count(*) as events from x where identity is not null group by identity order by events desc, identity limit 10""")
def top_identities(spark, sf):
    return chart_data("OSI_003", ecs_events(spark, sf))


@query("network_graph", ids="A42 J8", views="v_flows", sql="""
    with e as (select si as source, di as target, cast(sum(bytes_sent) as bigint) as weight, count(*) as events from v_flows group by all),
      n as (select node from (select source as node, events from e union all select target, events from e) group by node order by sum(events) desc, node limit 200)
    select * from e where source in (select node from n) and target in (select node from n)""")
def network_graph(spark, sf):
    return charts.network_edges(flows_as_ecs(spark, sf), "source.ip", "destination.ip", "network.bytes", 200)


@query("sankey_links", ids="J9", views="v_flows", sql="""
    with p as (select si as source, di as target, count(*) as value from v_flows group by all),
      n as (select label, row_number() over (order by substring(md5(label), 1, 3), label) - 1 as node from (select source as label from p union select target from p))
    select source, target, value, a.node as source_node, b.node as target_node from p join n a on a.label = source join n b on b.label = target""")
def sankey_links(spark, sf):
    return chart_data("LG_003", flows_as_ecs(spark, sf))


@query("port_radar", ids="A44", views="v_flows", sql="""
    select dp as "destination.port", count(*) as frequency, cast(sum(bytes_sent) as bigint) as volume, max(risk_score) as risk from v_flows group by dp""")
def port_radar(spark, sf):
    return chart_data("LG_005", flows_as_ecs(spark, sf))


@query("scatter_points", ids="A45", views="v_events", sql="""
    select ts as "@timestamp", dp as "destination.port", pr as "network.protocol", bytes_sent as "network.bytes" from v_events""")
def scatter_points(spark, sf):
    return chart_data("SC_011", ecs_events(spark, sf))
