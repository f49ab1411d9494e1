"""Sources and sinks: each query writes rows of the supplied tables in a source's format below the
shared folder and reads them back through the source, or sends them through a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..operators import filters, normalize
from ..operators.history import outcome_history
from ..plans.ticket_reports import ticket_reports
from ..session import shared_folder
from ..sinks import reports, tables
from ..sources import alerts, generic, packets, sessions, warehouse
from .core import query
from .correlation_queries import _ECS_FLOW, ISO, _block_sql
from .enrich_queries import _PATTERN_SQL, FUSED_SQL, ecs_events, fused_events
from .ioc_queries import BY_TICKET, USED, cases, logs
from .views import table, view


LOG_ROWS = 500_000  # lines of one file of a rotated log


def epoch_text(ts) -> F.Column:
    us = F.unix_micros(ts.cast("timestamp"))
    return F.concat(F.floor(us / 1000000).cast("string"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0"))


def _written(df: DataFrame, label: str, kind: str, suffix: str = "", **options) -> str:
    path = shared_folder(df.sparkSession, label) + suffix
    df.write.options(**options).format(kind).save(path)
    return path


# --- sources ---------------------------------------------------------------------------------

def packet_export(spark, sf) -> DataFrame:
    """Event rows as a packet-field export; some have a broken port or no time."""
    e = view(spark, sf, "v_events")
    tcp = F.col("transport") == "tcp"
    port = F.when(F.col("event_id") % 10 == 3, "abc").otherwise(F.col("sp").cast("string"))
    return e.select(
        F.when(F.col("event_id") % 10 != 4, epoch_text(F.col("ts"))).alias("frame.time_epoch"),
        F.when(F.col("event_id") % 8 == 0, "0.0.0.0").otherwise(F.col("si")).alias("ip.src"), F.col("di").alias("ip.dst"),
        F.col("bytes_sent").cast("string").alias("ip.len"),
        F.when(tcp, port).alias("tcp.srcport"), F.when(~tcp, port).alias("udp.srcport"),
        F.when(tcp, F.col("dp").cast("string")).alias("tcp.dstport"), F.when(~tcp, F.col("dp").cast("string")).alias("udp.dstport"),
        F.upper("pr").alias("_ws.col.Protocol"), F.col("osi_stack").alias("frame.protocols"), F.lit("64").alias("ip.ttl"),
        F.col("bytes_sent").cast("string").alias("frame.len"), F.col("dns_query").alias("dns.qry.name"), F.col("http_host").alias("http.host"),
        F.col("http_method").alias("http.request.method"), F.col("http_uri").alias("http.request.uri"),
        F.col("user_agent").alias("http.user_agent"), F.col("http_status").cast("string").alias("http.response.code"),
        F.col("tls_sni").alias("tls.handshake.extensions_server_name"), F.col("tls_ja3").alias("tls.handshake.ja3"),
        F.col("tls_version").alias("tls.record.version"), F.col("event_id").cast("string").alias("_ws.col.info"))


_EVENT_COLUMNS = "t si sp di dp pr bytes_sent dns_query http_method http_host http_uri http_user_agent http_status tls_sni tls_ja3 tls_version".split()
_FROM_PACKETS = """with e as (select t, case when event_id % 8 = 0 then null else si end as si, nullif(sp, 0) as sp, di, nullif(dp, 0) as dp, pr, bytes_sent, dns_query,
      http_method, http_host, http_uri, user_agent as http_user_agent, http_status, tls_sni, tls_ja3, tls_version from v_events
      where event_id % 10 not in (3, 4))"""


def packet_events(spark, sf) -> DataFrame:
    path = _written(packet_export(spark, sf), "packets", "csv", header=True)
    return normalize.events_from_packets(packets.read_packet_fields(spark, path), "capture")


@query("packet_field_events", ids="S1 P1", views="v_events", sql=_FROM_PACKETS + " select * from e")
def packet_field_events(spark, sf):
    return packet_events(spark, sf).select(_EVENT_COLUMNS)


@query("deep_packet_events", ids="S2 P3", views="v_events", sql="""
    select case when event_id % 10 = 4 then null else ts end as "@timestamp", case when event_id % 8 = 0 then '0.0.0.0' else si end as "source.ip",
      case when event_id % 10 = 3 then 0 else coalesce(sp, 0) end as "source.port", di as "destination.ip", dp as "destination.port", 64 as "network.ttl",
      upper(pr) as "network.protocol",
      case when transport = 'tcp' and (event_id % 10 = 3 or sp is not null) then 'tcp' else 'udp' end as "network.transport", bytes_sent as "network.bytes",
      osi_stack, coalesce(http_host, tls_sni) as "url.domain", dns_query as "dns.question.name", coalesce(http_status, 0) as "http.response.status_code",
      -1 as "icmp.type", cast(0 as bigint) as "tcp.seq", 'tshark' as "data.source", 10 as risk_score from v_events""")
def deep_packet_events(spark, sf):
    path = _written(packet_export(spark, sf), "deep-packets", "csv", header=True)
    rows = normalize.ecs_from_packets(packets.read_deep_packet_fields(spark, path))
    names = """@timestamp source.ip source.port destination.ip destination.port network.ttl network.protocol network.transport
        network.bytes osi_stack url.domain dns.question.name http.response.status_code icmp.type tcp.seq data.source risk_score"""
    return rows.select([c(x) for x in names.split()]).withColumn("@timestamp", c("@timestamp").cast("timestamp_ntz"))


def session_lines(spark, sf) -> DataFrame:
    """Event rows as conn-log lines, with comments, short lines and a broken port among them."""
    e = view(spark, sf, "v_events")
    n = F.col("event_id")
    fields = [
        epoch_text(F.col("ts")), F.concat(F.lit("C"), n.cast("string")), F.col("si"),
        F.when(n % 10 == 3, "x").otherwise(F.coalesce("sp", F.lit(0)).cast("string")), F.col("di"), F.col("dp").cast("string"),
        F.col("transport"), F.when(n % 3 == 0, "-").otherwise(F.col("pr")), F.col("duration").cast("string"),
        F.when(n % 5 == 0, "-").otherwise(F.col("bytes_sent").cast("string")), F.col("bytes_recv").cast("string"), F.col("conn_state")]
    line = F.concat_ws("\t", *fields)
    return e.select(F.when(n % 10 == 4, F.lit("#close\t2024")).when(n % 10 == 5, F.concat_ws("\t", *fields[:6])).otherwise(line).alias("value"))


@query("session_log_rows", ids="S3", views="v_events", sql="""
    select t as ts, 'C' || event_id as uid, si as orig_h, coalesce(sp, 0) as orig_p, di as resp_h, dp as resp_p, transport as proto,
      case when event_id % 3 = 0 then null else pr end as service, conn_state from v_events where event_id % 10 not in (3, 4, 5)""")
def session_log_rows(spark, sf):
    return sessions.read_sessions(spark, _written(session_lines(spark, sf), "conn-log", "text"))


_SESSION_ECS = """select ts as "@timestamp", si as "source.ip", case when event_id % 10 = 3 then null else coalesce(sp, 0) end as "source.port", di as "destination.ip",
      dp as "destination.port", upper(case when event_id % 3 = 0 then '-' else pr end) as "network.protocol", transport as "network.transport",
      case when event_id % 5 = 0 then 0 else bytes_sent end + bytes_recv as "network.bytes", 'zeek' as "data.source", 10 as risk_score from v_events"""
_SESSION_ECS_COLUMNS = ["@timestamp", "source.ip", "source.port", "destination.ip", "destination.port", "network.protocol", "network.transport",
                        "network.bytes", "data.source", "risk_score"]


def _ecs(df: DataFrame, names) -> DataFrame:
    return df.select([c(x) for x in names]).withColumn("@timestamp", c("@timestamp").cast("timestamp_ntz"))


@query("session_log_ecs_json", ids="S4", views="v_events", sql=_SESSION_ECS)
def session_log_ecs_json(spark, sf):
    e, n = view(spark, sf, "v_events"), F.col("event_id")
    rows = e.select(
        epoch_text(F.col("ts")).alias("ts"), F.col("si").alias("id.orig_h"),
        F.when(n % 10 == 3, "x").otherwise(F.coalesce("sp", F.lit(0)).cast("string")).alias("id.orig_p"),
        F.col("di").alias("id.resp_h"), F.col("dp").cast("string").alias("id.resp_p"), F.col("transport").alias("proto"),
        F.when(n % 3 == 0, "-").otherwise(F.col("pr")).alias("service"),
        F.when(n % 5 != 0, F.col("bytes_sent").cast("string")).alias("orig_bytes"), F.col("bytes_recv").cast("string").alias("resp_bytes"))
    return _ecs(sessions.read_sessions_as_ecs(spark, _written(rows, "conn-json", "json")), _SESSION_ECS_COLUMNS)


@query("session_log_ecs_text", ids="S4 S10", views="v_events", sql=_SESSION_ECS)
def session_log_ecs_text(spark, sf):
    e, n = view(spark, sf, "v_events"), F.col("event_id")
    fields = [
        epoch_text(F.col("ts")), F.concat(F.lit("C"), n.cast("string")), F.col("si"),
        F.when(n % 10 == 3, "x").otherwise(F.coalesce("sp", F.lit(0)).cast("string")), F.col("di"), F.col("dp").cast("string"),
        F.col("transport"), F.when(n % 3 == 0, "-").otherwise(F.col("pr")), F.lit("1.5"),
        F.when(n % 5 == 0, "-").otherwise(F.col("bytes_sent").cast("string")), F.col("bytes_recv").cast("string"), F.col("conn_state")]
    # Every part file begins with the header lines, as each file of a rotated log does; the number of files follows the rows.
    parts = max(4, -(-e.count() // LOG_ROWS))
    lines = e.select(F.pmod("event_id", F.lit(parts)).alias("part"), F.lit(2).alias("place"), F.concat_ws("\t", *fields).alias("value"))
    names = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_bytes\tresp_bytes\tconn_state"
    heads = F.array(F.struct(F.lit(0).alias("place"), F.lit("#separator \\x09").alias("value")), F.struct(F.lit(1).alias("place"), F.lit(names).alias("value")))
    headed = spark.range(parts).select(F.col("id").alias("part"), F.explode(heads).alias("h")).select("part", "h.*").unionByName(lines)
    lines = headed.repartitionByRange(parts, "part").sortWithinPartitions("part", "place").select("value")
    return _ecs(generic.load_file(spark, _written(lines, "conn", "text", ".log")), _SESSION_ECS_COLUMNS)


def alert_lines(spark, sf) -> DataFrame:
    e = view(spark, sf, "v_events").filter("alert_msg is not null")
    head = F.concat(F.date_format("ts", "MM/dd-HH:mm:ss.SSSSSS"), F.lit(" [**] ["), F.col("alert_id"), F.lit("] "), F.col("alert_msg"), F.lit(" [**] "))
    kind = F.when(F.col("event_id") % 3 == 0, "").otherwise("[Classification: Misc activity] ")
    ends = F.concat(
        F.lit("[Priority: "), F.col("alert_priority").cast("string"), F.lit("] {"), F.upper("transport"), F.lit("} "), F.col("si"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(":"), F.coalesce("sp", F.lit(0)).cast("string"))),
        F.lit(" -> "), F.col("di"), F.lit(":"), F.col("dp").cast("string"))
    line = F.when(F.col("event_id") % 11 == 7, "truncated line [**]").otherwise(F.concat(head, kind, ends))
    return e.select(line.alias("value"))


@query("alert_log_rows", ids="S5", views="v_events", sql="""
    select ts, alert_id, 1 as gid, alert_sid as sid, alert_msg as message, case when event_id % 3 = 0 then null else 'Misc activity' end as classification,
      alert_priority as priority, transport as proto, si as src_ip, case when event_id % 5 = 0 then null else coalesce(sp, 0) end as src_port, di as dst_ip, dp as dst_port
    from v_events where alert_msg is not null and event_id % 11 <> 7""")
def alert_log_rows(spark, sf):
    rows = alerts.read_alerts(spark, _written(alert_lines(spark, sf), "alerts", "text"), 2024)
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("alerts_of_two_engines", ids="S6 P8", views="v_events", sql="""
    select ts as "@timestamp", alert_msg as "alert.message", si as "source.ip", di as "destination.ip", dp as "destination.port", alert_id,
      case alert_priority when 1 then 90 when 2 then 60 else 30 end as risk_score, 'ids_alert' as "network.protocol" from v_events where alert_msg is not null and event_id % 11 <> 7""")
def alerts_of_two_engines(spark, sf):
    first = alerts.alerts_as_ecs(alerts.parse_alert_lines(alert_lines(spark, sf), 2024))
    second = first.withColumn("risk_score", F.lit(99))
    merged = alerts.merge_engines(first, second)
    return _ecs(merged, ["@timestamp", "alert.message", "source.ip", "destination.ip", "destination.port", "alert_id", "risk_score", "network.protocol"])


@query("unknown_csv", ids="S7 P9 P10", views="v_events", sql="""
    select ts as "@timestamp", si as "source.ip", di as "destination.ip", dp as "source.port", bytes_sent as "network.bytes", pr as "network.transport",
      'csv_mystery' as "data.source", 0 as risk_score from v_events""")
def unknown_csv(spark, sf):
    # The addresses are found by header, the port only by its values.
    rows = view(spark, sf, "v_events").select(
        F.col("pr").alias("Proto"), F.col("si").alias("Client_IP"), F.col("di").alias("machine"),
        epoch_text(F.col("ts")).alias("Event Time"), F.col("dp").alias("door"), F.col("bytes_sent").alias("octets_total"))
    names = ["@timestamp", "source.ip", "destination.ip", "source.port", "network.bytes", "network.transport", "data.source", "risk_score"]
    return _ecs(generic.load_file(spark, _written(rows, "unknown", "csv", ".csv", header=True)), names)


@query("unknown_json", ids="S8 P9", views="v_events", sql="""
    select ts as "@timestamp", si as "source.ip", di as "destination.ip", dp as "destination.port", bytes_sent as "network.bytes",
      'json_mystery' as "data.source", 10 as risk_score from v_events""")
def unknown_json(spark, sf):
    rows = view(spark, sf, "v_events").select(
        epoch_text(F.col("ts")).alias("ts"), F.col("si").alias("src_ip"), F.col("di").alias("dst_ip"), F.col("dp").alias("dst_port"),
        F.col("bytes_sent").alias("bytes"))
    names = ["@timestamp", "source.ip", "destination.ip", "destination.port", "network.bytes", "data.source", "risk_score"]
    return _ecs(generic.load_file(spark, _written(rows, "unknown", "json", ".json")), names)


@query("parquet_append", ids="S9 K3", views="v_events", sql="""
    select event_id, count(*) as copies from (select event_id from v_events union all select event_id from v_events) group by event_id""")
def parquet_append(spark, sf):
    rows = view(spark, sf, "v_events").select("event_id", "ts", "si")
    source, store = shared_folder(spark, "export"), shared_folder(spark, "table")
    tables.export_parquet(rows, source)
    generic.load_parquet(spark, source, store)
    return generic.load_parquet(spark, source, store, append=True).groupBy("event_id").agg(F.count("*").alias("copies"))


@query("ticket_lookup", ids="S12", views="v_tickets", sql="""
    select ticket_id, ioc_value, severity, coalesce(outcome, 'Unset') as outcome from v_tickets where ticket_id = '42'
    union all select ticket_id, ioc_value, severity, outcome from v_tickets where ioc_type = 'ip' and ioc_value = '10.0.1.7'""")
def ticket_lookup(spark, sf):
    tickets = view(spark, sf, "v_tickets").select("ticket_id", "ioc_type", "ioc_value", "severity", "outcome")
    by_id = warehouse.ticket_by_id(tickets, "42")
    return by_id.unionByName(warehouse.indicator_by_value(tickets, "ip", "10.0.1.7")).drop("ioc_type")


@query("geo_block_files", ids="S13", sql="""
    select cast(335544320 + n_nationkey * 4096 as bigint) as lo, cast(335544320 + n_nationkey * 4096 + (1 << (n_nationkey % 4 + 9)) - 1 as bigint) as hi,
      'N' || n_nationkey as country_code, n_name as country_name from nation""")
def geo_block_files(spark, sf):
    nation = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    network = F.concat(F.lit("20.0."), (key * 16).cast("string"), F.lit(".9/"), (F.lit(23) - key % 4).cast("string"))
    network = F.when(key * 16 < 256, network).otherwise(
        F.concat(F.lit("20.1."), (key * 16 - 256).cast("string"), F.lit(".9/"), (F.lit(23) - key % 4).cast("string")))
    blocks = nation.select(network.alias("network"), F.when(key % 2 == 0, key).alias("geoname_id"), key.alias("registered_country_geoname_id"))
    places = nation.select(key.alias("geoname_id"), F.concat(F.lit("N"), key.cast("string")).alias("country_iso_code"), F.col("n_name").alias("country_name"))
    return warehouse.read_geo(spark, _written(blocks, "geo-blocks", "csv", header=True), _written(places, "geo-places", "csv", header=True))


@query("platform_log_tail", ids="S14", views="v_app_log", sql="""
    select conv_id, turn, level, t from v_app_log order by t desc, conv_id desc limit 50""")
def platform_log_tail(spark, sf):
    path = _written(view(spark, sf, "v_app_log"), "app-log", "json")
    return warehouse.read_platform_log(spark, path, 50, ["t", "conv_id"]).select("conv_id", "turn", "level", "t")


# --- sinks -----------------------------------------------------------------------------------

@query("event_store_append", ids="K1", views="v_events", sql=_FROM_PACKETS + """
    select cast(to_timestamp(t) as date) as event_date, count(*) as events, cast(sum(bytes_sent) as bigint) as total, count(dns_query) as queries from e group by 1""")
def event_store_append(spark, sf):
    path = shared_folder(spark, "events")
    tables.append_events(packet_events(spark, sf), path)
    return tables.read_events(spark, path).groupBy("event_date").agg(
        F.count("*").alias("events"), F.sum("bytes_sent").alias("total"), F.count("dns_query").alias("queries"))


@query("event_store_range", ids="F1 K1", views="v_events", sql=_FROM_PACKETS + """
    select t, si, di, pr, bytes_sent from e where t between 1704844800 and 1705500000 and pr = 'dns'""")
def event_store_range(spark, sf):
    """Events of a time range from the stored date folders; the folders outside of it are not read."""
    path = shared_folder(spark, "events")
    tables.append_events(packet_events(spark, sf), path)
    found = filters.query_events(tables.read_events(spark, path), start=1704844800, end=1705500000, protocol="dns")
    return found.select("t", "si", "di", "pr", "bytes_sent")


@query("ingestion_counters", ids="A46", views="v_events", sql="""
    select count(*) as events_extracted, count(*) filter (event_id % 10 not in (3, 4)) as events_normalized, count(alert_msg) as alerts_matched from v_events""")
def ingestion_counters(spark, sf):
    raw = packets.read_packet_fields(spark, _written(packet_export(spark, sf), "packets", "csv", header=True))
    return tables.ingestion_counters(raw, normalize.events_from_packets(raw), view(spark, sf, "v_events").filter("alert_msg is not null"))


@query("ticket_append", ids="K2", views="v_tickets", sql="""
    select ticket_id, ioc_type, ioc_value, created_at, verdict, severity from v_tickets
    union all select 'SOC-1', 'ip', '10.0.0.5', null, 'MALICIOUS', 'high'""")
def ticket_append(spark, sf):
    path = shared_folder(spark, "tickets")
    tables.append_tickets(view(spark, sf, "v_tickets"), path)
    tables.create_ticket(spark, path, ticket_id="SOC-1", ioc_type="ip", ioc_value="10.0.0.5", verdict="MALICIOUS", severity="high")
    rows = spark.read.parquet(path).select("ticket_id", "ioc_type", "ioc_value", "created_at", "verdict", "severity")
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("table_export", ids="K5", views="v_events", sql="""
    select strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as "Timestamp", si as "Source IP", di as "Dest IP", pr as "Protocol", '' as "Service",
      coalesce(alert_msg, '') as "Alert" from v_events""")
def table_export(spark, sf):
    path = shared_folder(spark, "table-csv")
    tables.export_table(view(spark, sf, "v_events").withColumn("zeek_service", F.lit(None).cast("string")), path)
    return spark.read.option("header", True).option("emptyValue", "").csv(path).fillna("")


@query("fused_group_export", ids="K6", views="v_events", sql=FUSED_SQL + """,
      k as (select *, concat('5tuple=', si, ':', coalesce(cast(sp as varchar), 'None'), '->', di, ':', coalesce(cast(dp as varchar), 'None'), '/', transport,
        ',ts_bucket=', cast(floor(epoch_us(ts) / 1e6) as bigint)) as corr_key from fused)
    select 'flow_' || substring(md5(corr_key), 1, 8) as corr_id, concat('[CORR_GROUP]', chr(10), 'corr_id=flow_', substring(md5(corr_key), 1, 8), chr(10), 'corr_level=flow', chr(10),
      'corr_key=', corr_key, chr(10), 'corr_confidence=low', chr(10), array_to_string([""" + ", ".join([
        _block_sql("'META'", {"ts": ISO, "community_id": "community_id"}), _block_sql("'FLOW'", {**_ECS_FLOW, "bytes": "cast(bytes as varchar)"}),
        "case when pr <> 'unknown' then " + _block_sql("'PROTO:' || upper(pr)", {
            "protocol": "pr", "risk_score": "cast(risk_score as varchar)", "osi_stack": "osi_stack", "dns_query": "dns", "tls_sni": "sni", "ja3": "ja3"}) + " end",
        "case when alert_id <> '' then " + _block_sql("'PROTO:IDS'", {"alert_id": "alert_id", "mitre_attack": "mitre_attack"}) + " end"]) + """], chr(10))) as text
    from k""")
def fused_group_export(spark, sf):
    from ..operators.correlate import group_text

    path = shared_folder(spark, "groups-text")
    reports.export_groups(fused_events(spark, sf), path)
    text = spark.read.option("lineSep", "\n\n").text(path).select(F.rtrim(F.col("value")).alias("text")).filter("text <> ''")
    return text.select(F.regexp_extract("text", "corr_id=(\\S+)", 1).alias("corr_id"), "text")


@query("intel_objects", ids="K7", views="v_events", sql=FUSED_SQL + """,
      top as (select * from fused where risk_score > 0 and si is not null and di is not null and bytes is not null)
    select 'network-traffic' as object_type, 'network-traffic--' || md5(community_id) as object_id, concat('{"type":"network-traffic","id":"network-traffic--', md5(community_id),
      '","start":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '","src":"', si, '","dst":"', di, '","protocols":["', pr, '"],"byte_count":', bytes, '}') as body from top
    union all select 'relationship', 'relationship--' || md5(community_id), concat('{"type":"relationship","relationship_type":"related-to","target_ref":"network-traffic--', md5(community_id),
      '","description":"Risk Score: ', risk_score, ' | Tools: ', fused_sources, '"}') from top""")
def intel_objects(spark, sf):
    return reports.intel_objects(fused_events(spark, sf))


@query("machine_report", ids="K8", views="v_events", sql=_PATTERN_SQL.replace("s as (", "ps as (").replace("from s)", "from ps)") + """,
      s as (select si from v_events group by si having count(distinct dp) > 20 or count(distinct di) > 15),
      d as (select list_extract(string_split(dns_query, '.'), -2) as l from v_events where pr = 'dns' group by 1 having count(*) > 20)
    select count(*) as total_events, (select count(*) from p join tt on pattern = indicator) as ttps_detected, (select count(*) from s) + (select count(*) from d)
      + (count(*) filter (pr = 'icmp') > 10 and count(*) filter (pr = 'icmp') / count(*) > 0.05)::int as anomalies_found, least(20, count(*))::integer as sample_size,
      max(t) as newest from v_events""")
def machine_report(spark, sf):
    report = reports.machine_report(view(spark, sf, "v_events"))
    return report.select("summary.*", F.size("events_sample").alias("sample_size"), F.element_at("events_sample", 1)["timestamp"].alias("newest"))


@query("ticket_reports", ids="K9", views=USED, sql=BY_TICKET + """,
      n as (select ticket_id, count(*) as sightings, count(distinct log_type) as protocols, count(distinct (log_type, matched_field)) as coverage,
        count(distinct src_ip) as sources from w group by ticket_id),
      h as (select a.ticket_id, count(b.ticket_id) as total_tickets, round(count(*) filter (b.outcome = 'Threat') / nullif(count(b.outcome), 0), 4) as ratio
        from v_cases a left join v_cases b on a.ioc_type = b.ioc_type and a.ioc_value = b.ioc_value and a.ticket_id <> b.ticket_id group by a.ticket_id),
      s as (select ticket_id, coalesce(sightings, 0) as sightings, coalesce(coverage, 0) as coverage, coalesce(sources, 0) as sources, total_tickets, ratio,
        0.75::double * (least(1.0, coalesce(sightings, 0) / 100) * 0.5::double + least(1.0, coalesce(protocols, 0) / 3) * 0.5::double) + 0.25::double * coalesce(ratio, 0.5::double) as score
        from v_cases join h using (ticket_id) left join n using (ticket_id))
    select ticket_id, sightings, coverage, sources, total_tickets, ratio as threat_ratio, score,
      case when score > 0.6 then 'Threat-consistent' when score < 0.4 then 'False-positive-consistent' else 'Inconclusive' end as assessment from s""")
def ticket_report_rows(spark, sf):
    rows = ticket_reports(logs(spark, sf), cases(spark, sf))
    return rows.select(
        "ticket_id", F.col("current_window.total_ioc_sightings").alias("sightings"), F.col("current_window.coverage").alias("coverage"),
        F.col("current_window.distinct_src_ip_count").alias("sources"), "history.total_tickets", "history.threat_ratio",
        "confidence.score", "confidence.assessment")
