"""Indicator look-ups and the aggregates of ticket windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ioc, window_index
from ..session import cut_lineage
from ..sources import warehouse
from .core import query
from .views import view

LOG_VIEWS = {"conn": "v_log_conn", "dns": "v_log_dns", "http": "v_log_http", "ssl": "v_log_ssl", "smtp": "v_log_smtp"}
USED = "v_cases v_log_conn v_log_dns v_log_http v_log_ssl v_log_smtp"


def logs(spark, sf) -> dict[str, DataFrame]:
    renamed = {"orig_h": "src_ip", "resp_h": "dst_ip"}
    return {name: view(spark, sf, v).withColumnsRenamed(renamed) for name, v in LOG_VIEWS.items()}


def cases(spark, sf) -> DataFrame:
    return view(spark, sf, "v_cases")


def found_by_indicator(spark, sf) -> DataFrame:
    return ioc.sightings(logs(spark, sf), cases(spark, sf))


def found_near_tickets(spark, sf) -> DataFrame:
    """Sightings around any ticket, written once, as counts and runs of values both read them."""
    near = ioc.within_any_window(logs(spark, sf), cases(spark, sf))
    return cut_lineage(window_index.near_windows(ioc.sightings(near, cases(spark, sf)), cases(spark, sf)), "sightings")


_COLUMNS = ["src_country", "dst_country", "query", "qtype_name", "rcode_name", "host", "uri", "method", "status_code",
            "user_agent", "server_name", "version", "ja3", "mailfrom", "rcptto"]
_HAS = {
    "conn": ["src_country", "dst_country"], "dns": ["query", "qtype_name", "rcode_name"],
    "http": ["host", "uri", "method", "status_code", "user_agent"], "ssl": ["server_name", "version", "ja3"],
    "smtp": ["mailfrom", "rcptto"],
}


def _part(log: str, field: str, kind: str, condition: str) -> str:
    details = ", ".join(
        (f"cast(l.{x} as varchar)" if x in _HAS[log] else "cast(null as varchar)") + f" as {x}" for x in _COLUMNS)
    return (f"select i.ioc_type, i.ioc_value, '{log}' as log_type, '{field}' as matched_field, l.ts, l.orig_h as src_ip, "
            f"l.resp_h as dst_ip, {details} from {LOG_VIEWS[log]} l join i on i.ioc_type = '{kind}' and ({condition})")


def _suffix(column: str) -> str:
    return f"l.{column} = i.ioc_value or l.{column} like '%.' || i.ioc_value"


_PARTS = [_part(log, f"{side}_ip", "ip", f"l.{column} = i.ioc_value")
          for log in LOG_VIEWS for side, column in (("src", "orig_h"), ("dst", "resp_h"))]
_PARTS += [
    _part("dns", "dns.query", "domain", _suffix("query")),
    _part("http", "http.host", "domain", _suffix("host")),
    _part("ssl", "ssl.server_name", "domain", _suffix("server_name")),
    _part("http", "http.uri", "url", "contains(l.uri, i.ioc_value)"),
    _part("smtp", "smtp.mailfrom", "email", "l.mailfrom = i.ioc_value"),
    _part("smtp", "smtp.rcptto", "email", "contains(l.rcptto, i.ioc_value)"),
    _part("http", "http.user_agent", "user_agent", "l.user_agent = i.ioc_value"),
]
FOUND = ("with i as (select distinct ioc_type, ioc_value from v_cases), found as (" + " union all ".join(_PARTS) + ")")
BY_TICKET = FOUND + (", w as (select c.ticket_id, f.* from found f join v_cases c on c.ioc_type = f.ioc_type and c.ioc_value = f.ioc_value"
                     " and f.ts between c.t0 - interval 24 hour and c.t0 + interval 24 hour)")


@query("ioc_predicates", ids="F2", views="v_log_dns v_log_http v_log_smtp", sql="""
    select 'dns.query' as matched_field, query as value, count(*) as events from v_log_dns where query = 'd7.example.com' or query like '%.d7.example.com' group by all
    union all select 'http.host', host, count(*) from v_log_http where host = 'd7.example.com' or host like '%.d7.example.com' group by all
    union all select 'http.uri', uri, count(*) from v_log_http where contains(uri, '/p/4') group by all
    union all select 'smtp.rcptto', rcptto, count(*) from v_log_smtp where contains(rcptto, 'a17@corp.org') group by all
    union all select 'smtp.mailfrom', mailfrom, count(*) from v_log_smtp where mailfrom like 'u%@d7.example.com' and mailfrom = 'u7@d7.example.com' group by all
    union all select 'http.user_agent', user_agent, count(*) from v_log_http where user_agent = 'agent/3' group by all
    union all select 'src_ip', orig_h, count(*) from v_log_dns where orig_h = '10.0.0.7' group by all
    union all select 'dst_ip', resp_h, count(*) from v_log_dns where resp_h = '172.16.0.7' group by all
    union all select 'files.md5', md5(uri), count(*) from v_log_http where md5(uri) = md5('/p/4?u=4') group by all
    union all select 'files.sha256', sha256(uri), count(*) from v_log_http where sha256(uri) = sha256('/p/4?u=4') group by all""")
def ioc_predicates(spark, sf):
    tables, out = logs(spark, sf), None
    # Files are the resources of the web log, known by their digests.
    tables["files"] = tables["http"].select(F.md5("uri").alias("md5"), F.sha1("uri").alias("sha1"), F.sha2("uri", 256).alias("sha256"))
    digest = {name: getattr(hashlib, name)(b"/p/4?u=4").hexdigest() for name in ("md5", "sha1", "sha256")}
    wanted = [
        ("domain", "d7.example.com", "dns"), ("domain", "d7.example.com", "http"), ("url", "/p/4", "http"), ("email", "a17@corp.org", "smtp"),
        ("email", "u7@d7.example.com", "smtp"), ("user_agent", "agent/3", "http"), ("ip", "10.0.0.7", "dns"), ("ip", "172.16.0.7", "dns"),
        ("md5", digest["md5"], "files"), ("sha256", digest["sha256"], "files")]
    for kind, value, table in wanted:
        df = tables[table]
        for field, condition in ioc.ioc_predicates(kind, value, table, df.columns):
            part = df.filter(condition).groupBy(F.col(field.split(".")[-1]).alias("value")).agg(
                F.count("*").alias("events")).withColumn("matched_field", F.lit(field))
            out = part if out is None else out.unionByName(part)
    return out


@query("warehouse_log_tables", ids="S11 S12", views="v_log_conn v_log_dns v_log_smtp", sql="""
    select 'conn' as log_type, orig_h as src_ip, count(*) as events from v_log_conn group by all
    union all select 'dns', orig_h, count(*) from v_log_dns group by all union all select 'smtp', orig_h, count(*) from v_log_smtp where orig_h = '10.0.0.7' group by all""")
def warehouse_log_tables(spark, sf):
    """Log tables found in the catalog by name, a missing one left out; one of them narrowed down to a ticket's rows."""
    for name in ("conn", "dns", "smtp"):
        view(spark, sf, f"v_log_{name}").withColumnRenamed("orig_h", "id_orig_h").createOrReplaceTempView(f"store_{name}")
    found = warehouse.log_tables(spark, ["store_conn", "store_dns", "store_smtp", "store_telnet"])
    of_ticket = found["store_smtp"].withColumn("ticket_id", F.col("src_ip"))
    found["store_smtp"] = warehouse.ids_results_of_ticket(of_ticket, "10.0.0.7")
    out = None
    for name, df in found.items():
        part = df.groupBy("src_ip").agg(F.count("*").alias("events")).withColumn("log_type", F.lit(name.removeprefix("store_")))
        out = part if out is None else out.unionByName(part)
    return out


@query("ioc_sightings", ids="J4", views=USED, sql=FOUND + """
    select ioc_type, ioc_value, log_type, matched_field, count(*) as sightings, count(distinct src_ip) as distinct_src,
      count(distinct dst_ip) as distinct_dst, min(ts) as first_seen, max(ts) as last_seen from found group by all""")
def ioc_sightings(spark, sf):
    return ioc.window_aggregate(found_by_indicator(spark, sf), ["ioc_type", "ioc_value"])


@query("ticket_window_aggregate", ids="A5", views=USED, sql=BY_TICKET + """
    select ticket_id, log_type, matched_field, count(*) as sightings, count(distinct src_ip) as distinct_src,
      count(distinct dst_ip) as distinct_dst, min(ts) as first_seen, max(ts) as last_seen from w group by all""")
def ticket_window_aggregate(spark, sf):
    return window_index.ticket_aggregate(found_near_tickets(spark, sf), cases(spark, sf))


@query("ticket_sighting_rollup", ids="A6", views=USED, sql=BY_TICKET + """,
      x as (select ticket_id, ts, unnest([('total', 'all'), ('log_type', log_type), ('matched_field', matched_field)]) as g from w)
    select ticket_id, g[1] as level, g[2] as name, count(*) as sightings, min(ts) as first_seen, max(ts) as last_seen from x group by all""")
def ticket_sighting_rollup(spark, sf):
    return ioc.sighting_rollup(ticket_window_aggregate(spark, sf), ["ticket_id"])


@query("ioc_distinct_addresses", ids="A7", views=USED, sql=FOUND + """
    select distinct ioc_type, ioc_value, 'src' as side, src_ip as ip from found
    union all select distinct ioc_type, ioc_value, 'dst', dst_ip from found""")
def ioc_distinct_addresses(spark, sf):
    return ioc.distinct_addresses(found_by_indicator(spark, sf), ["ioc_type", "ioc_value"])


@query("ioc_country_pairs", ids="A8", views=USED, sql=FOUND + """
    select ioc_value, src_country, dst_country, events from (select ioc_value, coalesce(src_country, 'Unknown') as src_country,
      coalesce(dst_country, 'Unknown') as dst_country, count(*) as events,
      row_number() over (partition by ioc_value order by count(*) desc, coalesce(src_country, 'Unknown'), coalesce(dst_country, 'Unknown')) as r
      from found where log_type = 'conn' group by 1, 2, 3) where r <= 20""")
def ioc_country_pairs(spark, sf):
    conn = {"conn": logs(spark, sf)["conn"]}
    return ioc.country_pairs(ioc.sightings(conn, cases(spark, sf)), ["ioc_value"], 20)


@query("country_pairs_top", ids="A8", views="v_log_conn", sql="""
    select coalesce(src_country, 'Unknown') as src_country, dst_country, count(*) as events from v_log_conn group by 1, 2
    order by events desc, src_country, dst_country limit 20""")
def country_pairs_top(spark, sf):
    return ioc.country_pairs(view(spark, sf, "v_log_conn"), limit=20)


@query("ioc_temporal_distribution", ids="A9", views=USED, sql=FOUND + """
    select ioc_type, ioc_value, time_bucket(interval 60 minute, ts, timestamp '1970-01-01') as bucket_start,
      time_bucket(interval 60 minute, ts, timestamp '1970-01-01') + interval 60 minute as bucket_end, count(*) as events from found group by all""")
def ioc_temporal_distribution(spark, sf):
    return ioc.temporal_distribution(found_by_indicator(spark, sf), ["ioc_type", "ioc_value"])


@query("temporal_distribution_15m", ids="A9", views="v_log_conn", sql="""
    select time_bucket(interval 15 minute, ts, timestamp '1970-01-01') as bucket_start,
      time_bucket(interval 15 minute, ts, timestamp '1970-01-01') + interval 15 minute as bucket_end, count(*) as events from v_log_conn group by all""")
def temporal_distribution_15m(spark, sf):
    return ioc.temporal_distribution(view(spark, sf, "v_log_conn"), bucket_minutes=15)


def _details_sql(log: str, distinct: list[str], counted: list[str]) -> str:
    parts = [f"select ioc_value, 'unique_{x}' as metric, cast(null as varchar) as value, count(distinct {x}) as events "
             f"from found where log_type = '{log}' group by ioc_value" for x in distinct]
    parts += [f"select ioc_value, '{x}', {x}, count(*) from found where log_type = '{log}' group by all" for x in counted]
    return FOUND + " union all ".join(parts)


@query("ioc_dns_details", ids="A10", views=USED, sql=_details_sql("dns", ["query"], ["qtype_name", "rcode_name"]))
def ioc_dns_details(spark, sf):
    return ioc.dns_details(found_by_indicator(spark, sf), ["ioc_value"])


@query("ioc_http_details", ids="A11", views=USED, sql=_details_sql("http", ["user_agent"], ["method", "status_code"]))
def ioc_http_details(spark, sf):
    return ioc.http_details(found_by_indicator(spark, sf), ["ioc_value"])


@query("ioc_tls_details", ids="A12", views=USED, sql=_details_sql("ssl", ["ja3", "server_name"], ["version"]))
def ioc_tls_details(spark, sf):
    return ioc.tls_details(found_by_indicator(spark, sf), ["ioc_value"])


@query("ioc_smtp_details", ids="A13", views=USED, sql=_details_sql("smtp", ["mailfrom", "rcptto"], []))
def ioc_smtp_details(spark, sf):
    return ioc.smtp_details(found_by_indicator(spark, sf), ["ioc_value"])


_PEERS = """
    p as (select ioc_value, unnest([src_ip, dst_ip]) as ip from found),
    n as (select ioc_value, ip, count(*) as events from p group by all),
    r as (select *, row_number() over (partition by ioc_value order by events desc, ip) as position from n)"""


@query("ioc_top_peers", ids="A14", views=USED, sql=FOUND + "," + _PEERS + """
    select ioc_value, ip, events, cast(position as int) as position from r where position <= 10""")
def ioc_top_peers(spark, sf):
    return ioc.top_peers(ioc.peer_counts(found_by_indicator(spark, sf), ["ioc_value"]), ["ioc_value"])


@query("ioc_peer_concentration", ids="A14", views=USED, sql=FOUND + "," + _PEERS + """,
    s as (select ioc_value, cast(sum(events) as bigint) as total, max(events) as a, sum(events) filter (position <= 3) as b from r group by all)
    select ioc_value, total, a / total as top1_share, b / total as top3_share,
      case when a / total > 0.7 then 'high' when a / total > 0.5 then 'medium' else 'low' end as concentration_level from s""")
def ioc_peer_concentration(spark, sf):
    return ioc.peer_concentration(ioc.peer_counts(found_by_indicator(spark, sf), ["ioc_value"]), ["ioc_value"])


@query("ioc_peer_concentration_distinct", ids="A14", views=USED, sql=FOUND + """,
    d as (select distinct ioc_value, 's' as side, src_ip as ip from found union all select distinct ioc_value, 'd', dst_ip from found),
    n as (select ioc_value, ip, count(*) as events from d group by all),
    r as (select *, row_number() over (partition by ioc_value order by events desc, ip) as position from n),
    s as (select ioc_value, cast(sum(events) as bigint) as total, max(events) as a, sum(events) filter (position <= 3) as b from r group by all)
    select ioc_value, total, a / total as top1_share, b / total as top3_share,
      case when a / total > 0.7 then 'high' when a / total > 0.5 then 'medium' else 'low' end as concentration_level from s""")
def ioc_peer_concentration_distinct(spark, sf):
    peers = ioc.peer_counts(found_by_indicator(spark, sf), ["ioc_value"], distinct_sides=True)
    return ioc.peer_concentration(peers, ["ioc_value"])


@query("ioc_temporal_metrics", ids="A15", views=USED, sql=FOUND + """,
    b as (select ioc_value, date_trunc('hour', ts) as h, count(*) as n from found group by all),
    s as (select ioc_value, count(*) as bucket_count, count(*) as active_buckets, avg(n) as m, var_pop(n) as v from b group by all)
    select ioc_value, bucket_count, active_buckets, m as avg_per_bucket, round(v, 6) as variance,
      case when v < m * 0.3 and m > 1 then 'strong' when v < m * 0.7 and m > 0.5 then 'moderate' else 'none' end as beaconing_indicator from s""")
def ioc_temporal_metrics(spark, sf):
    buckets = ioc.temporal_distribution(found_by_indicator(spark, sf), ["ioc_value"])
    return ioc.temporal_metrics(buckets, ["ioc_value"]).withColumn("variance", F.round("variance", 6))


@query("ticket_window_assets", ids="A16", views=USED, sql=BY_TICKET + """,
    d as (select ticket_id, 's' as side, src_ip as ip from w union all select ticket_id, 'd', dst_ip from w)
    select ticket_id, count(distinct ip) filter (side = 's') as distinct_src_ip_count, count(distinct ip) filter (side = 'd') as distinct_dst_ip_count,
      count(distinct ip) as distinct_ip_total, greatest(0, count(distinct ip) - 1) as distinct_ip_excluding_trigger from d group by ticket_id""")
def ticket_window_assets(spark, sf):
    return window_index.ticket_assets(found_near_tickets(spark, sf), cases(spark, sf))


_FIELDS = {"conn": ["ts", "t", "src_ip", "dst_ip"] + _HAS["conn"], **{k: ["ts", "t", "src_ip", "dst_ip"] + _HAS[k] for k in ("dns", "http", "ssl", "smtp")}}


@query("log_field_review", ids="A17 S11", views=USED, sql=FOUND + " select distinct log_type, matched_field as field, 'used' as use from found union all "
       + " union all ".join(f"select '{k}', '{x}', 'present'" for k, v in _FIELDS.items() for x in v))
def log_field_review(spark, sf):
    return ioc.field_review(logs(spark, sf), found_by_indicator(spark, sf))
