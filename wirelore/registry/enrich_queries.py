"""Joins, fusion and technique mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, fusion, rules, ttp
from ..plans.ticket_reports import window_features
from ..session import cut_lineage
from .core import query
from .ioc_queries import FOUND, USED, _PEERS, found_by_indicator
from .views import table, view


@query("session_match", ids="J1", views="v_events v_sessions", sql="""
    select event_id, uid as zeek_uid, service as zeek_service, conn_state as zeek_conn_state from (
      select e.event_id, s.uid, s.service, s.conn_state, row_number() over (partition by e.event_id order by s.ts, s.uid) as rn
      from v_events e left join v_sessions s on s.orig_h = e.si and s.resp_h = e.di and (e.sp is null or s.orig_p = e.sp)
        and (e.dp is null or s.resp_p = e.dp) and abs(s.ts - e.t) <= 1.0) where rn = 1""")
def session_match(spark, sf):
    matched = enrich.match_sessions(view(spark, sf, "v_events"), view(spark, sf, "v_sessions"))
    return matched.select("event_id", "zeek_uid", "zeek_service", "zeek_conn_state")


@query("session_match_wide", ids="J1", views="v_events v_sessions", sql="""
    select event_id, uid as zeek_uid from (
      select e.event_id, s.uid, row_number() over (partition by e.event_id order by s.ts, s.uid) as rn
      from v_events e left join v_sessions s on s.orig_h = e.si and s.resp_h = e.di and abs(s.ts - e.t) <= 7200) where rn = 1""")
def session_match_wide(spark, sf):
    nothing = F.lit(None).cast("int")
    events = view(spark, sf, "v_events").withColumns({"sp": nothing, "dp": nothing})
    return enrich.match_sessions(events, view(spark, sf, "v_sessions"), 7200).select("event_id", "zeek_uid")


_ALERTS = """a as (select event_id as alert_key, si as src_ip, case when event_id % 3 = 0 then null else sp end as src_port, di as dst_ip,
      case when event_id % 5 = 0 then null else dp end as dst_port, alert_sid as sid, alert_msg as message,
      alert_priority as priority, 'class' as classification from v_events where alert_msg is not null)"""


def _alerts(spark, sf):
    events = view(spark, sf, "v_events").filter(F.col("alert_msg").isNotNull())
    return events.select(
        F.col("event_id").alias("alert_key"), F.col("si").alias("src_ip"),
        F.when(F.col("event_id") % 3 != 0, F.col("sp")).alias("src_port"), F.col("di").alias("dst_ip"),
        F.when(F.col("event_id") % 5 != 0, F.col("dp")).alias("dst_port"), F.col("alert_sid").alias("sid"),
        F.col("alert_msg").alias("message"), F.col("alert_priority").alias("priority"), F.lit("class").alias("classification"))


_MATCH = "with " + _ALERTS + """,
      m as (select a.*, e.t, e.event_id, row_number() over (partition by alert_key order by e.t, e.event_id) as rn from a left join v_events e
        on (e.si = a.src_ip and (a.src_port is null or e.sp is null or e.sp = a.src_port))
        or (e.di = a.dst_ip and (a.dst_port is null or e.dp is null or e.dp = a.dst_port)))"""


@query("alert_match", ids="J2", views="v_events", sql=_MATCH + " select alert_key, sid, event_id from m where rn = 1")
def alert_match(spark, sf):
    return enrich.match_alerts(_alerts(spark, sf), view(spark, sf, "v_events")).select("alert_key", "sid", "event_id")


@query("alert_attach", ids="J2", views="v_events", sql=_MATCH + """,
      f as (select *, row_number() over (partition by event_id order by alert_key) as k, count(*) over (partition by event_id) as n from m where rn = 1)
    select e.event_id, f.sid as alert_sid, f.message as alert_msg, f.priority as alert_priority, f.classification as alert_class,
      coalesce(f.n, 0) as alert_count from v_events e left join f on f.event_id = e.event_id and f.k = 1""")
def alert_attach(spark, sf):
    events = view(spark, sf, "v_events")
    matched = enrich.match_alerts(_alerts(spark, sf), events)
    return enrich.attach_alerts(events, matched).select(
        "event_id", "alert_sid", "alert_msg", "alert_priority", "alert_class", "alert_count")


def _blocks(spark, sf):
    return view(spark, sf, "v_geo_blocks").select(
        "lo", "hi", F.col("code").alias("country_code"), F.col("country").alias("country_name"))


_GEO = """with g as (select h.*, case when h.ip_number is null then 'PRIVATE' else coalesce(b.code, 'XX') end as country_code,
      case when h.ip_number is null then 'Private Network' else coalesce(b.country, 'Unknown') end as country_name,
      h.ip_number is not null as is_external from v_hosts h left join v_geo_blocks b on h.ip_number between b.lo and b.hi) """


@query("geo_lookup", ids="J3", views="v_hosts v_geo_blocks", sql=_GEO + "select distinct ip, country_code, country_name, is_external from g")
def geo_lookup(spark, sf):
    return enrich.geo_of_addresses(view(spark, sf, "v_hosts"), _blocks(spark, sf))


@query("geo_totals", ids="A43 J3", views="v_hosts v_geo_blocks", sql=_GEO + """
    select country_code, count(*) as events, cast(sum(bytes_sent) as bigint) as total_bytes, max(risk_score) as max_risk from g group by 1""")
def geo_totals(spark, sf):
    placed = enrich.with_geo(view(spark, sf, "v_hosts"), _blocks(spark, sf), "ip", prefix="")
    return placed.groupBy("country_code").agg(
        F.count("*").alias("events"), F.sum("bytes_sent").alias("total_bytes"), F.max("risk_score").alias("max_risk"))


@query("asset_and_reputation", ids="J7", views="v_flows", sql="""
    with a as (select concat('10.0.', cast(s_suppkey // 256 as varchar), '.', cast(s_suppkey % 256 as varchar)) as ip, n_name as owner,
        case when s_acctbal > 5000 then 'Critical' else 'Low' end as importance from supplier join nation on n_nationkey = s_nationkey),
      r as (select concat('172.16.', cast(p_partkey // 256 as varchar), '.', cast(p_partkey % 256 as varchar)) as ip, p_size as score, p_brand as kind from part where p_size > 25)
    select si, di, a.owner, a.importance, r.kind as threat_type, r.score as reputation_score, count(*) as flows
    from v_flows f left join a on a.ip = f.si left join r on r.ip = f.di group by all""")
def asset_and_reputation(spark, sf):
    read = lambda t: table(spark, sf, t)
    quad = lambda prefix, k: F.concat(F.lit(prefix), F.floor(F.col(k) / 256).cast("string"), F.lit("."), (F.col(k) % 256).cast("string"))
    assets = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        quad("10.0.", "s_suppkey").alias("ip_address"), F.lit("server").alias("asset_type"), F.col("n_name").alias("owner"),
        F.when(F.col("s_acctbal") > 5000, "Critical").otherwise("Low").alias("importance"))
    reputation = read("part").filter("p_size > 25").select(
        quad("172.16.", "p_partkey").alias("indicator"), F.col("p_size").alias("reputation_score"), F.col("p_brand").alias("threat_type"))
    pairs = view(spark, sf, "v_flows").groupBy("si", "di").agg(F.count("*").alias("flows"))
    known = enrich.with_reputation(enrich.with_assets(pairs, assets, "si"), reputation, "di")
    return known.select("si", "di", "owner", "importance", "threat_type", "reputation_score", "flows")


ECS_NAMES = {
    "ts": "@timestamp", "si": "source.ip", "sp": "source.port", "di": "destination.ip", "dp": "destination.port",
    "pr": "network.protocol", "transport": "network.transport", "bytes_sent": "network.bytes", "alert_msg": "alert.message",
    "data_source": "data.source", "community_id": "network.community_id", "tls_ja3": "tls.handshake.ja3",
    "tls_sni": "tls.client.server_name", "dns_query": "dns.question.name", "user_agent": "user_agent.original",
    "http_host": "url.domain", "http_method": "http.request.method",
}
FUSED = {
    "network.community_id": "community_id", "@timestamp": "ts", "source.ip": "si", "source.port": "sp", "destination.ip": "di",
    "destination.port": "dp", "network.transport": "transport", "network.protocol": "pr", "network.bytes": "bytes",
    "risk_score": "risk_score", "alert_id": "alert_id", "tls.handshake.ja3": "ja3", "tls.client.server_name": "sni",
    "dns.question.name": "dns", "user_agent.original": "agent", "osi_stack": "osi_stack", "mitre_attack": "mitre_attack",
    "fused_sources": "fused_sources",
}
FUSED_SQL = """with fused as (select community_id, min(ts) as ts, min(si) as si, min(sp) as sp, min(di) as di, min(dp) as dp, min(transport) as transport,
      coalesce(max(pr) filter (data_source = 'zeek' and pr <> '-'), max(pr) filter (data_source = 'tshark'), 'unknown') as pr,
      coalesce(max(bytes_sent) filter (data_source = 'zeek'), cast(sum(bytes_sent) filter (data_source = 'tshark') as bigint), max(bytes_sent)) as bytes,
      max(risk_score) as risk_score, array_to_string(list_sort(list_distinct(list(alert_id) filter (alert_id is not null))), ', ') as alert_id,
      max(tls_ja3) as ja3, max(tls_sni) as sni, max(dns_query) as dns, max(user_agent) as agent,
      coalesce(max(osi_stack) filter (data_source = 'tshark'), max(osi_stack)) as osi_stack,
      coalesce(max(case when alert_msg ilike '%scan%' or alert_msg ilike '%nmap%' then 'Discovery (T1046)'
        when alert_msg ilike '%c2%' or alert_msg ilike '%beacon%' then 'Command and Control (T1071)'
        when alert_msg ilike '%exploit%' or alert_msg ilike '%cve-%' then 'Execution (T1203)'
        when alert_msg ilike '%brute%force%' then 'Credential Access (T1110)'
        when alert_msg is not null then 'General/Unknown' end), 'None / Benign') as mitre_attack,
      array_to_string(list_sort(list_distinct(list(data_source))), ', ') as fused_sources
    from v_events where community_id is not null and community_id <> 'none' group by community_id)"""


def ecs_events(spark, sf):
    return view(spark, sf, "v_events").withColumnsRenamed(ECS_NAMES)


def fused_events(spark, sf):
    return fusion.fuse(ecs_events(spark, sf))


@query("tool_fusion", ids="A4", views="v_events", sql=FUSED_SQL + " select * from fused")
def tool_fusion(spark, sf):
    return fused_events(spark, sf).withColumnsRenamed(FUSED)


# --- patterns and techniques -----------------------------------------------------------------

def _shown(patterns):
    return patterns.withColumn("evidence", F.array_join("evidence", "; "))


@query("pattern_beaconing", ids="T1", views="v_events", sql="""
    with g as (select si, di, t - lag(t) over (partition by si, di order by t) as gap from v_events),
      s as (select si, di, count(gap) + 1 as n, avg(gap) as m, stddev_pop(gap) as sd from g group by all having count(gap) >= 4),
      f as (select * from s where sd / m < 0.6)
    select unnest(['beaconing', 'c2_pattern']) as pattern, 'HIGH' as confidence, concat('Connection: ', si, '->', di, ':None; Beacons: ', n,
      '; Interval: ', printf('%.1f', m), 's (±', printf('%.1f', sd), 's); Consistency: ', printf('%.1f', (1 - sd / m) * 100), '%') as evidence from f""")
def pattern_beaconing(spark, sf):
    events = view(spark, sf, "v_events").withColumn("dp", F.lit(None).cast("int"))
    return _shown(ttp.beaconing_pattern(events, max_cv=0.6))


@query("pattern_scan", ids="T2", views="v_events", sql="""
    with s as (select si, count(distinct dp) as p, count(distinct di) as d from v_events group by si having count(distinct dp) > 20 or count(distinct di) > 10)
    select 'port_scan' as pattern, case when p > 50 then 'HIGH' else 'MEDIUM' end as confidence,
      concat('Source: ', si, '; Unique destinations: ', d, '; Unique ports: ', p) as evidence from s""")
def pattern_scan(spark, sf):
    return _shown(ttp.scan_pattern(view(spark, sf, "v_events")))


@query("pattern_dns", ids="T3", views="v_names", sql="""
    with d as (select count(*) as n, arg_min(url, (t, url)) as u from v_names where length(url) > 50)
    select unnest(['dns_tunneling', 'dns_exfil']) as pattern, 'MEDIUM' as confidence,
      concat('Long DNS queries: ', n, '; Example: ', substring(u, 1, 60), '...') as evidence from d where n > 5""")
def pattern_dns(spark, sf):
    names = view(spark, sf, "v_names").withColumns({"pr": F.lit("dns"), "dns_query": F.col("url")})
    return _shown(ttp.dns_pattern(names))


@query("pattern_tls", ids="T4", views="v_events", sql="""
    with b as (select t, di, tls_ja3 from v_events where pr = 'tls' and tls_sni is null),
      d as (select distinct di from (select * from b order by t, di limit 5)), j as (select distinct tls_ja3 from (select * from b order by t, tls_ja3 limit 3))
    select unnest(['tls_no_sni', 'tls_direct_ip']) as pattern, 'HIGH' as confidence, concat('TLS connections without SNI: ', (select count(*) from b),
      '; Destinations: ', (select string_agg(di, ', ' order by di) from d), '; JA3 fingerprints: ', (select string_agg(tls_ja3, ', ' order by tls_ja3) from j)) as evidence""")
def pattern_tls(spark, sf):
    return _shown(ttp.tls_pattern(view(spark, sf, "v_events"), destinations=5, fingerprints=3))


@query("pattern_tls_destinations", ids="T4", views="v_events", sql="""
    with b as (select di, tls_ja3, count(*) as n from v_events where pr = 'tls' and tls_sni is null and di is not null group by all)
    select unnest(['tls_no_sni', 'tls_direct_ip']) as pattern, 'HIGH' as confidence, concat_ws('; ', 'TLS connections without SNI: ' || n, 'Destination: ' || di,
      'JA3 fingerprint: ' || nullif(tls_ja3, '')) as evidence from b where (select sum(n) from b) > 3""")
def pattern_tls_destinations(spark, sf):
    return _shown(ttp.tls_pattern(view(spark, sf, "v_events")))


@query("pattern_remote_services", ids="T5", views="v_flows", sql="""
    select 'rdp' as pattern, 'MEDIUM' as confidence, concat('RDP connections: ', count(*)) as evidence from v_flows where dp = 3389 or sp = 3389
    union all select 'ssh', 'MEDIUM', concat('SSH connections: ', count(*)) from v_flows where dp = 22 or sp = 22
    union all select 'smb', 'MEDIUM', concat('SMB connections: ', count(*)) from v_flows where dp in (445, 139) or sp in (445, 139)""")
def pattern_remote_services(spark, sf):
    return _shown(ttp.remote_service_pattern(view(spark, sf, "v_flows")))


_TECHNIQUE_VALUES = ", ".join(
    f"('{ind}', '{tid}', '{name}', '{tactic}')" for tid, name, tactic, inds in ttp.TECHNIQUES for ind in inds)
_PATTERN_SQL = f"""
    with tt(indicator, technique_id, technique_name, tactic) as (values {_TECHNIQUE_VALUES}),
      n as (select count(*) filter (dp = 3389 or sp = 3389) as rdp, count(*) filter (dp = 22 or sp = 22) as ssh,
        count(*) filter (dp in (445, 139) or sp in (445, 139)) as smb, count(*) filter (pr = 'tls' and tls_sni is null) as bare from v_events),
      s as (select count(distinct dp) as p from v_events group by si having count(distinct dp) > 20 or count(distinct di) > 10),
      p as (select 'rdp' as pattern, 'MEDIUM' as confidence from n where rdp > 2 union all select 'ssh', 'MEDIUM' from n where ssh > 2
        union all select 'smb', 'MEDIUM' from n where smb > 2 
        union all select unnest(['tls_no_sni', 'tls_direct_ip']), 'HIGH' from (select distinct di, tls_ja3 from v_events where pr = 'tls' and tls_sni is null), n where bare > 3
        union all select 'port_scan', case when p > 50 then 'HIGH' else 'MEDIUM' end from s)"""


def _patterns(spark, sf):
    return ttp.detect_patterns(view(spark, sf, "v_events"))


@query("techniques_from_patterns", ids="T6 J5", views="v_events", sql=_PATTERN_SQL + """
    select technique_id, technique_name, tactic, confidence, pattern from p join tt on pattern = indicator""")
def techniques_from_patterns(spark, sf):
    return ttp.techniques_of(_patterns(spark, sf)).drop("evidence")


@query("techniques_per_tactic", ids="A25", views="v_events", sql=_PATTERN_SQL + """
    select tactic, count(*) as techniques from p join tt on pattern = indicator group by tactic""")
def techniques_per_tactic(spark, sf):
    return ttp.techniques_per_tactic(ttp.techniques_of(_patterns(spark, sf)))


# --- rules over ticket windows ---------------------------------------------------------------

_FEATURES = FOUND + ", " + _PEERS.strip() + """,
      sh as (select ioc_value, max(events) / sum(events) as top1_share from r group by all),
      b as (select ioc_value, date_trunc('hour', ts) as h, count(*) as n from found group by all),
      bs as (select ioc_value, count(*) as bucket_count, avg(n) as bucket_avg, var_pop(n) as bucket_variance from b group by all),
      cov as (select ioc_value, count(*) as coverage from (select distinct ioc_value, log_type, matched_field from found) group by all),
      f as (select ioc_value, count(*) filter (log_type = 'dns') as dns_n, count(*) filter (log_type = 'smtp') as smtp_n,
        count(*) filter (qtype_name = 'TXT') as txt, count(*) filter (qtype_name = 'NULL') as nul, count(distinct query) as uq,
        count(*) filter (rcode_name in ('NXDOMAIN', '3')) as nx, count(*) filter (method = 'POST') as post,
        count(distinct user_agent) as ua, count(*) filter (log_type = 'http') as http_n, count(*) filter (log_type = 'ssl') as tls_n from found group by all),
      x as (select * from f join sh using (ioc_value) join bs using (ioc_value) join cov using (ioc_value)),
      rules as (
        select ioc_value, 2 as ord, 'T1572' as technique_id, 0.75::double as confidence from x where txt > 5 or nul > 0
        union all select ioc_value, 3, 'T1583.001', 0.65 from x where uq > 50 union all select ioc_value, 4, 'T1071.004', 0.55 from x where nx > 10
        union all select ioc_value, 5, 'T1071.001', 0.7 from x where post > 0 union all select ioc_value, 6, 'T1071.001', 0.6 from x where ua > 5
        union all select ioc_value, 7, 'T1573.002', 0.65 from x where tls_n > 0 union all select ioc_value, 8, 'T1566.002', 0.6 from x where smtp_n > 0
        union all select ioc_value, 12, 'T1041', 0.55 from x where top1_share > 0.8 union all select ioc_value, 13, 'T1071.001', 0.5 from x where coverage >= 3
        union all select ioc_value, 14, 'T1571', 0.6 from x where bucket_count >= 3 and bucket_variance < bucket_avg * 0.5 and bucket_avg > 1)"""
_RULES = {"dns": ("N1", (2, 3, 4), rules.dns_rules), "web": ("N2", (5, 6, 7), rules.web_rules), "mail": ("N3", (8,), rules.mail_rules),
          "exfiltration": ("N5", (12, 13), rules.exfiltration_rules), "temporal": ("N6", (14,), rules.temporal_rules)}


def _register(name, ids, orders, build):
    sql = _FEATURES + f" select ioc_value, technique_id, confidence from rules where ord in ({', '.join(map(str, orders))})"

    @query(f"rules_{name}", ids=ids, views=USED, sql=sql)
    def run(spark, sf):
        features = window_features(cut_lineage(found_by_indicator(spark, sf), "sightings"), ["ioc_value"])
        hits = features.select("ioc_value", F.explode(F.filter(F.array(*build()), lambda r: r.isNotNull())).alias("r"))
        return hits.select("ioc_value", "r.technique_id", "r.confidence")


for _name, (_ids, _orders, _build) in _RULES.items():
    _register(_name, _ids, _orders, _build)


@query("rules_remote_access", ids="N4", views="v_flows", sql="""
    with x as (select si, count(*) filter (dp = 22) as ssh, count(*) filter (dp = 3389) as rdp, count(*) filter (dp = 8080) as telnet from v_flows group by si)
    select si, 'T1021.004' as technique_id, 0.6::double as confidence, concat('SSH connections involving IOC (', ssh, ' sightings) may indicate remote access or lateral movement') as justification from x where ssh > 0
    union all select si, 'T1021.001', 0.65, concat('RDP connections involving IOC (', rdp, ' sightings) may indicate remote access or lateral movement') from x where rdp > 0
    union all select si, 'T1021.004', 0.7, concat('Telnet connections (', telnet, ' sightings) to IOC indicate cleartext remote access attempt') from x where telnet > 0""")
def rules_remote_access(spark, sf):
    seen = lambda port: F.count_if(F.col("dp") == port)
    windows = view(spark, sf, "v_flows").groupBy("si").agg(
        seen(22).alias("ssh_sightings"), seen(3389).alias("rdp_sightings"), seen(8080).alias("telnet_sightings"))
    hits = windows.select("si", F.explode(F.filter(F.array(*rules.remote_access_rules()), lambda r: r.isNotNull())).alias("r"))
    return hits.select("si", "r.technique_id", "r.confidence", "r.justification")


@query("rules_ranked", ids="N7", views=USED, sql=_FEATURES + """,
      u as (select *, row_number() over (partition by ioc_value, technique_id order by ord) as k from rules),
      o as (select *, row_number() over (partition by ioc_value order by confidence desc, ord) as position from u where k = 1)
    select ioc_value, technique_id, confidence, cast(position as int) as position from o where position <= 6""")
def rules_ranked(spark, sf):
    features = window_features(cut_lineage(found_by_indicator(spark, sf), "sightings"), ["ioc_value"])
    mapped = rules.map_techniques(features).select("ioc_value", F.posexplode("observed_ttps").alias("i", "ttp"))
    return mapped.select("ioc_value", "ttp.technique_id", "ttp.confidence", (F.col("i") + 1).alias("position"))
