"""Projections and scalar expressions (P family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, attack, layers, text
from ..functions.columns import time_bucket
from ..operators.normalize import align, clean_endpoints
from ..functions.columns import c
from ..schemas import ECS_SCHEMA
from .core import query
from .views import table, view

_TACTICS = attack.SIGNATURES


def _case(rows, otherwise: str) -> str:
    whens = " ".join(f"when {cond} then {value}" for cond, value in rows)
    return f"case {whens} else {otherwise} end"


@query("placeholder_hygiene", ids="P2", views="v_events", sql="""
    select event_id, case when si in ('0.0.0.0', '::', '', 'N/A', 'unknown') then null else si end as si,
      case when data_source = 'snort' then null else di end as di,
      case when sp = 0 then null else sp end as sp, case when dp = 0 then null else dp end as dp
    from v_events""")
def placeholder_hygiene(spark, sf):
    events = view(spark, sf, "v_events").withColumn(
        "di", F.when(F.col("data_source") == "snort", F.lit("0.0.0.0")).otherwise(F.col("di")))
    return clean_endpoints(events).select("event_id", "si", "di", "sp", "dp")


@query("protocol_names", ids="P4", views="v_events", sql="""
    select event_id, case when pr = 'icmp' then upper(list_extract(string_split(osi_stack, ':'), -1))
      else upper(pr) end as protocol from v_events""")
def protocol_names(spark, sf):
    shown = F.when(F.col("pr") == "icmp", "data").otherwise(F.concat(F.lit("["), F.col("pr"), F.lit("]")))
    return view(spark, sf, "v_events").select(
        "event_id", layers.protocol_name(shown, F.col("osi_stack")).alias("protocol"))


@query("transport_names", ids="P5", views="v_events", sql="""
    select event_id, case when transport = 'tcp' and sp is not null then 'tcp' else 'udp' end as transport from v_events""")
def transport_names(spark, sf):
    tcp_port = F.when(F.col("transport") == "tcp", F.col("sp"))
    return view(spark, sf, "v_events").select("event_id", layers.transport_name(tcp_port).alias("transport"))


@query("url_domains", ids="P6", views="v_events", sql="""
    select event_id, coalesce(http_host, tls_sni) as url_domain from v_events""")
def url_domains(spark, sf):
    return view(spark, sf, "v_events").select("event_id", F.coalesce("http_host", "tls_sni").alias("url_domain"))


_HEX4 = "lower(lpad(to_hex({0}), 4, '0'))"
_HEX8 = ("lower(lpad(to_hex(cast(split_part({0},'.',1) as bigint) * 16777216 + cast(split_part({0},'.',2) as bigint) * 65536"
         " + cast(split_part({0},'.',3) as bigint) * 256 + cast(split_part({0},'.',4) as bigint)), 8, '0'))")


@query("flow_ids", ids="P7", views="v_flows", sql=f"""
    with h as (select si, sp, di, dp, transport, {_HEX8.format('si')} as a, {_HEX8.format('di')} as b,
        {_HEX4.format('sp')} as p, {_HEX4.format('dp')} as q from v_flows),
      o as (select *, case when a < b or (a = b and sp <= dp) then a || b else b || a end as ips,
        case when a < b or (a = b and sp <= dp) then p || q else q || p end as ports from h)
    select si, sp, di, dp, transport, '1:' || base64(unhex(sha1(unhex('0000' || ips ||
      case transport when 'tcp' then '06' else '11' end || '00' || ports)))) as flow_id, count(*) as flows
    from o group by all""")
def flow_ids(spark, sf):
    flows = view(spark, sf, "v_flows").select("si", "sp", "di", "dp", "transport")
    distinct = flows.groupBy(*flows.columns).agg(F.count("*").alias("flows"))
    return addresses.add_flow_id(distinct, "si", "di", "sp", "dp", "transport", "flow_id")


@query("priority_risk", ids="P8", views="v_events", sql="""
    select event_id, case when alert_priority is null then 10 when alert_priority = 1 then 90
      when alert_priority = 2 then 60 else 30 end as risk from v_events""")
def priority_risk(spark, sf):
    risk = attack.priority_risk(F.coalesce(F.col("alert_priority").cast("string"), F.lit("n/a")))
    return view(spark, sf, "v_events").select("event_id", risk.alias("risk"))


@query("schema_alignment", ids="P10", views="v_events", sql="""
    select ts as "@timestamp", si as "source.ip", dp as "destination.port", cast(null as varchar) as "tcp.flags",
      cast(null as bigint) as "tcp.seq", case when data_source = 'snort' then risk_score else 10 end as risk_score
    from v_events""")
def schema_alignment(spark, sf):
    raw = view(spark, sf, "v_events").select(
        F.col("ts").alias("@timestamp"), F.col("si").alias("source.ip"),
        F.col("dp").cast("string").alias("destination.port"), F.col("event_id").alias("not_in_schema"),
        F.when(F.col("data_source") == "snort", F.col("risk_score")).alias("risk_score"))
    aligned = align(raw)
    assert aligned.columns == ECS_SCHEMA.fieldNames()
    return aligned.select(*[c(x) for x in (
        "@timestamp", "source.ip", "destination.port", "tcp.flags", "tcp.seq", "risk_score")])


_LAYER_CASE = _case(
    [(f"regexp_matches(lower(osi_stack), '{'|'.join(words)}')", str(layer)) for layer, words in layers.LAYER_WORDS]
    + [(f"dp in ({', '.join(map(str, layers.APPLICATION_PORTS))})", "7"), ("dp between 1 and 65535", "4")], "3")


@query("osi_layer_of_rows", ids="P11", views="v_events", sql=f"""
    with s as (select event_id, dp, case when event_id % 4 = 0 then null else osi_stack end as osi_stack from v_events)
    select event_id, {_LAYER_CASE} as layer from s""")
def osi_layer_of_rows(spark, sf):
    stack = F.when(F.col("event_id") % 4 != 0, F.col("osi_stack"))
    return view(spark, sf, "v_events").select("event_id", layers.osi_layer(stack, F.col("dp")).alias("layer"))


@query("attack_signatures", ids="P12", views="v_events", sql=f"""
    select event_id, {_case([(f"regexp_matches(alert_msg, '(?i){f}')", f"'{ta}'") for f, ta, _ in _TACTICS], "'Unknown'")} as tactic,
      {_case([(f"regexp_matches(alert_msg, '(?i){f}')", f"'{te}'") for f, _, te in _TACTICS], "'None'")} as technique
    from v_events""")
def attack_signatures(spark, sf):
    mapped = attack.signature_mapping(F.col("alert_msg"))
    return view(spark, sf, "v_events").select("event_id", mapped["tactic"].alias("tactic"), mapped["technique"].alias("technique"))


@query("attack_labels", ids="P13", sql=f"""
    select doc_id, {_case([(f"text ilike '%{f}%'", f"'{ta} ({te})'") for f, ta, te in _TACTICS]
                          + [("text is not null", "'General/Unknown'")], "null")} as label
    from documents""")
def attack_labels(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", attack.signature_label(F.col("text")).alias("label"))


@query("attack_labels_fusion", ids="P14", views="v_events", sql="""
    select event_id, case when alert_msg ilike '%scan%' or alert_msg ilike '%nmap%' then 'Discovery (T1046)'
      when alert_msg ilike '%c2%' or alert_msg ilike '%beacon%' then 'Command and Control (T1071)'
      when alert_msg ilike '%exploit%' or alert_msg ilike '%cve-%' then 'Execution (T1203)'
      when alert_msg ilike '%brute%force%' then 'Credential Access (T1110)'
      when alert_msg is not null then 'General/Unknown' end as label from v_events""")
def attack_labels_fusion(spark, sf):
    return view(spark, sf, "v_events").select("event_id", attack.fusion_label(F.col("alert_msg")).alias("label"))


@query("name_entropy", ids="P15", views="v_names", sql="""
    with ch as (select page_id, host, unnest(string_split(host, '')) as c from v_names),
      k as (select page_id, host, c, count(*) as n from ch group by all)
    select page_id, host, round(-sum(n / length(host) * log2(n / length(host))), 6) as entropy from k group by all""")
def name_entropy(spark, sf):
    return view(spark, sf, "v_names").select(
        "page_id", "host", F.round(text.string_entropy(F.col("host")), 6).alias("entropy"))


@query("group_entropy", ids="P16", views="v_events", sql="""
    with k as (select si, dp, count(*) as n from v_events group by all),
      s as (select *, sum(n) over (partition by si) as total from k)
    select si, cast(sum(n) as bigint) as n_values, count(*) as n_distinct,
      round(-sum(n / total * log2(n / total)), 6) + 0.0 as entropy from s group by si""")
def group_entropy(spark, sf):
    return text.value_entropy(view(spark, sf, "v_events"), ["si"], "dp").withColumn("entropy", F.round("entropy", 6))


@query("payload_entropy", ids="P17", sql="""
    with p as (select page_id, upper(hex(encode(html))) as h from pages),
      ch as (select page_id, length(h) // 2 as total, unnest(regexp_extract_all(h, '..')) as b from p),
      k as (select page_id, total, b, count(*) as n from ch group by all),
      e as (select page_id, round(-sum(n / total * log2(n / total)), 4) as payload_entropy from k group by page_id)
    select page_id, payload_entropy, substring(h, 1, 64) || '...' as payload_hex_preview from e join p using (page_id)""")
def payload_entropy(spark, sf):
    payload = F.hex(F.encode("html", "UTF-8"))
    return table(spark, sf, "pages").select(
        "page_id", text.payload_entropy(payload).alias("payload_entropy"),
        text.payload_preview(payload).alias("payload_hex_preview"))


@query("packet_indicators", ids="P18", views="v_events", sql="""
    select event_id, tls_version, tls_sni, http_method, http_host, http_uri, user_agent as http_user_agent
    from v_events where tls_version is not null or http_method is not null""")
def packet_indicators(spark, sf):
    events = view(spark, sf, "v_events")
    return events.filter(F.col("tls_version").isNotNull() | F.col("http_method").isNotNull()).select(
        "event_id", "tls_version", "tls_sni", "http_method", "http_host", "http_uri",
        F.col("user_agent").alias("http_user_agent"))


@query("second_level_labels", ids="P19", views="v_names", sql="""
    select page_id, case when contains(host, '.') then list_extract(string_split(host, '.'), -2) else host end as label from v_names""")
def second_level_labels(spark, sf):
    return view(spark, sf, "v_names").select("page_id", text.second_level_label(F.col("host")).alias("label"))


@query("text_previews", ids="P20", sql="""
    select doc_id, case when length(text) > 60 then substring(text, 1, 60) || '...' else text end as preview from documents""")
def text_previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("time_buckets", ids="P21", views="v_events", sql="""
    select event_id, cast(floor(t / 5) * 5 as bigint) as bucket from v_events""")
def time_buckets(spark, sf):
    return view(spark, sf, "v_events").select("event_id", time_bucket(F.col("t"), 5).alias("bucket"))


@query("table_protocols", ids="P22", views="v_events", sql="""
    select event_id, case pr when 'http' then 'HTTP' when 'dns' then 'DNS' else upper(pr) end as protocol from v_events""")
def table_protocols(spark, sf):
    return view(spark, sf, "v_events").select("event_id", layers.table_protocol(F.col("pr")).alias("protocol"))


@query("mac_addresses", ids="P23", sql="""
    with m as (select event_id, case when event_id % 2 = 0 then substring(md5(cast(event_id as varchar)), 1, 12)
        else props end as s from events),
      x as (select event_id, case when event_id % 2 = 0 then regexp_replace(s, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') else s end as value from m)
    select event_id, value, regexp_full_match(trim(value), '([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}') as is_mac from x""")
def mac_addresses(spark, sf):
    digest = F.substring(F.md5(F.col("event_id").cast("string")), 1, 12)
    mac = F.regexp_replace(digest, "(..)(..)(..)(..)(..)(..)", "$1:$2:$3:$4:$5:$6")
    value = F.when(F.col("event_id") % 2 == 0, mac).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", value.alias("value"))
    return rows.withColumn("is_mac", text.is_mac_address(F.col("value")))
