"""Blocks, correlation groups and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, correlate, validate
from .core import query
from .enrich_queries import FUSED_SQL, ecs_events, fused_events
from .views import table, view

_NOTHING = "('', '-', 'n/a', 'unknown', 'null', 'none')"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def _usable(x: str) -> str:
    return f"case when lower(trim({x})) not in {_NOTHING} then {x} end"


def _block_sql(kind: str, facts: dict[str, str]) -> str:
    values = [f"{_usable(facts[k])}" for k in sorted(facts)]
    lines = ", ".join(f"'{k}=' || {v}" for k, v in zip(sorted(facts), values))
    return f"case when coalesce({', '.join(values)}) is not null then array_to_string(['[' || {kind} || ']', {lines}], chr(10)) end"


def _text_sql(*parts: str) -> str:
    return f"array_to_string([{', '.join(parts)}], chr(10))"


PACKET_NAMES = {
    "ts": "@timestamp", "ts_precise": "frame.time_epoch", "frame_number": "frame.number", "si": "source.ip", "di": "destination.ip",
    "sp": "source.port", "dp": "destination.port", "transport": "network.transport", "ip_id": "ip.id", "ttl": "ip.ttl",
    "tcp_seq": "tcp.seq", "dns_id": "dns.id", "dns_query": "dns.question.name", "ja3": "tls.handshake.ja3",
    "sni": "tls.client.server_name", "http_host": "http.host", "http_method": "http.request.method",
    "http_status": "http.response.code", "eth_src": "eth.src",
}
SESSION_NAMES = {"orig_h": "id.orig_h", "orig_p": "id.orig_p", "resp_h": "id.resp_h", "resp_p": "id.resp_p"}

_PACKET_FACTS = {
    "META": {"ts": ISO, "ts_precise": "ts_precise", "frame_number": "frame_number"},
    "FLOW": {"src_ip": "si", "dst_ip": "di", "src_port": "sp", "dst_port": "dp", "proto": "transport"},
    "PROTO:IP": {"id": "ip_id", "ttl": "ttl"},
    "PROTO:TCP": {"seq": "tcp_seq"},
    "PROTO:DNS": {"question.name": "dns_query", "id": "dns_id"},
    "PROTO:TLS": {"handshake.ja3": "ja3", "client.server_name": "sni"},
    "PROTO:HTTP": {"request.method": "http_method", "response.code": "http_status", "host": "http_host"},
}
_ECS_FLOW = {"src_ip": "si", "dst_ip": "di", "src_port": "cast(sp as varchar)", "dst_port": "cast(dp as varchar)", "proto": "transport"}


def packets(spark, sf):
    return view(spark, sf, "v_packets").withColumnsRenamed(PACKET_NAMES)


def session_log(spark, sf):
    whole = F.floor("ts").cast("long").cast("string")
    return view(spark, sf, "v_sessions").withColumn("ts", whole).withColumnsRenamed(SESSION_NAMES)


@query("packet_blocks", ids="P24", views="v_packets", sql="select event_id, "
       + _text_sql(*[_block_sql(f"'{k}'", f) for k, f in _PACKET_FACTS.items()]) + " as blocks from v_packets")
def packet_blocks(spark, sf):
    return blocks.packet_blocks(packets(spark, sf)).select("event_id", blocks.blocks_text(F.col("blocks")).alias("blocks"))


_SESSION_FACTS = {
    "'META'": {"ts": "cast(cast(floor(ts) as bigint) as varchar)", "zeek_uid": "uid"},
    "'FLOW'": {"src_ip": "orig_h", "src_port": "cast(orig_p as varchar)", "dst_ip": "resp_h", "dst_port": "cast(resp_p as varchar)"},
    "'PROTO:' || upper(service)": {"service": "service", "conn_state": "conn_state"},
}


@query("session_blocks", ids="P25", views="v_sessions", sql="select uid, "
       + _text_sql(*[_block_sql(k, f) for k, f in _SESSION_FACTS.items()]) + " as blocks from v_sessions")
def session_blocks(spark, sf):
    return blocks.session_blocks(session_log(spark, sf)).select("uid", blocks.blocks_text(F.col("blocks")).alias("blocks"))


@query("alert_blocks", ids="P26", views="v_events", sql="select event_id, " + _text_sql(
    _block_sql("'META'", {"ts": ISO, "alert_id": "alert_id"}), _block_sql("'FLOW'", _ECS_FLOW),
    _block_sql("'PROTO:IDS'", {"alert_id": "alert_id", "alert_message": "alert_msg", "risk_score": "cast(risk_score as varchar)"}),
) + " as blocks from v_events where alert_msg is not null")
def alert_blocks(spark, sf):
    alerts = ecs_events(spark, sf).filter("`alert.message` is not null")
    return blocks.alert_blocks(alerts).select("event_id", blocks.blocks_text(F.col("blocks")).alias("blocks"))


@query("fused_blocks", ids="P27", views="v_events", sql=FUSED_SQL + " select community_id, " + _text_sql(
    _block_sql("'META'", {"ts": ISO, "community_id": "community_id"}), _block_sql("'FLOW'", {**_ECS_FLOW, "bytes": "cast(bytes as varchar)"}),
    "case when lower(pr) not in " + _NOTHING + " then " + _block_sql("'PROTO:' || upper(pr)", {
        "protocol": "pr", "risk_score": "cast(risk_score as varchar)", "osi_stack": "osi_stack", "dns_query": "dns", "tls_sni": "sni", "ja3": "ja3"}) + " end",
    "case when alert_id <> '' then " + _block_sql("'PROTO:IDS'", {"alert_id": "alert_id", "mitre_attack": "mitre_attack"}) + " end",
) + " as blocks from fused")
def fused_blocks(spark, sf):
    rows = blocks.fused_blocks(fused_events(spark, sf))
    return rows.select(F.col("`network.community_id`").alias("community_id"), blocks.blocks_text(F.col("blocks")).alias("blocks"))


@query("transform_counters", ids="P28", views="v_packets", sql="""
    select count(*) as transformed, cast(0 as bigint) as skipped_empty, cast(0 as bigint) as skipped_l1l2 from v_packets""")
def transform_counters(spark, sf):
    return blocks.transform_counters(packets(spark, sf), "tshark")


@query("log_record_collapse", ids="P29", sql="""
    select role as l, case when lower(trim(text)) in ('', '-', 'n/a', 'unknown', 'null', 'none') then null else text end as m,
      cast(turn % 3 as varchar) as t, count(*) as dc from conversations group by all""")
def log_record_collapse(spark, sf):
    log = table(spark, sf, "conversations").select(
        F.col("role").alias("level"), F.col("text").alias("message"), (F.col("turn") % 3).alias("timestamp"))
    return blocks.collapse_log(log)


# --- correlation -----------------------------------------------------------------------------

def tagged_blocks(spark, sf):
    """Packets and sessions as blocks with a text order column."""
    left = blocks.transform_batch(packets(spark, sf), "tshark").select(F.format_string("p%012d", "event_id").alias("ord"), "blocks")
    right = blocks.transform_batch(session_log(spark, sf), "zeek").select(F.concat(F.lit("s"), F.col("uid")).alias("ord"), "blocks")
    return left.unionByName(right)


_FACT_ROWS = " union all ".join(
    [f"select printf('p%012d', event_id) as ord, '{t}' as type, '{k}' as fact, {_usable(v)} as value from v_packets"
     for t, f in _PACKET_FACTS.items() for k, v in f.items()]
    + [f"select 's' || uid, {t}, '{k}', {_usable(v)} from v_sessions" for t, f in _SESSION_FACTS.items() for k, v in f.items()])
_META_SQL = f""" facts as (select * from ({_FACT_ROWS}) where value is not null),
      meta as (select ord, max(value) filter (type = 'META' and fact = 'ts') as ts, max(value) filter (type = 'META' and fact = 'ts_precise') as ts_precise,
        max(value) filter (type = 'META' and fact = 'frame_number') as frame_number, max(value) filter (type = 'META' and fact = 'zeek_uid') as zeek_uid,
        max(value) filter (type = 'FLOW' and fact = 'src_ip') as src_ip, max(value) filter (type = 'FLOW' and fact = 'dst_ip') as dst_ip,
        coalesce(max(value) filter (type = 'FLOW' and fact = 'src_port'), 'None') as src_port,
        coalesce(max(value) filter (type = 'FLOW' and fact = 'dst_port'), 'None') as dst_port, max(value) filter (type = 'FLOW' and fact = 'proto') as proto,
        max(value) filter (type = 'PROTO:DNS' and fact = 'id') as dns_id, max(value) filter (type = 'PROTO:IP' and fact = 'id') as ip_id,
        max(value) filter (type = 'PROTO:TCP' and fact = 'seq') as tcp_seq from facts group by ord)"""
_KEY_SQL = _META_SQL + """,
      ends as (select *, concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port) as ends, src_ip is not null and dst_ip is not null and proto is not null as five from meta),
      c as (select *, case when frame_number is not null then ['frame.number=' || frame_number, 'packet', 'high', 'packet_level']
        when ts_precise is not null and five and ip_id is not null and tcp_seq is not null
          then [concat('ts=', ts_precise, ',5tuple=', ends, '/', proto, ',ip_id=', ip_id, ',tcp_seq=', tcp_seq), 'packet', 'medium', 'packet_derived']
        when dns_id is not null and five then [concat('dns_id=', dns_id, ',5tuple=', ends), 'transaction', 'medium', 'transaction_level']
        when dns_id is not null then ['dns_id=' || dns_id, 'transaction', 'low', 'transaction_level']
        when zeek_uid is not null then ['zeek_uid=' || zeek_uid, 'flow', 'medium', 'flow_level']
        when five and ts is not null then [concat('5tuple=', ends, '/', proto, ',ts_bucket=', cast(floor(
          case when contains(ts, 'T') then epoch_us(cast(ts as timestamp)) / 1e6 else cast(ts as double) end / 60) * 60 as bigint)), 'flow', 'low', 'flow_level']
        when five then [concat('5tuple=', ends, '/', proto), 'flow', 'low', 'flow_level']
        else [null, null, null, 'uncorrelated'] end as c from ends),
      k as (select ord, c[1] as corr_key, c[2] as corr_level, c[3] as corr_confidence, c[4] as corr_method from c)"""
CORR_VIEWS = "v_packets v_sessions"


def correlated(spark, sf, with_text: bool = False):
    """Packets and sessions with keys; with blocks for what is merged."""
    columns = ["ord", "corr_key", "corr_level", "corr_confidence", "corr_method", *(["blocks"] if with_text else ["meta"])]
    left = packets(spark, sf).withColumn("ord", F.format_string("p%012d", "event_id"))
    right = session_log(spark, sf).withColumn("ord", F.concat(F.lit("s"), F.col("uid")))
    rows = [correlate.correlated_batch(df, source, 60, with_text).select(columns) for df, source in ((left, "tshark"), (right, "zeek"))]
    return rows[0].unionByName(rows[1])


@query("block_parsing", ids="C1", views="v_packets", sql="""
    with x as (select event_id, 'META' as type, 'ts' as fact, """ + ISO + """ as value from v_packets union all select event_id, 'FLOW', 'dst_ip', di from v_packets
      union all select event_id, 'FLOW', 'src_ip', case when si = 'unknown' then null else si end from v_packets
      union all select event_id, 'PROTO:HTTP', 'request.uri', case when http_host is not null then '/?a=b=' || http_host end from v_packets)
    select * from x where value is not null""")
def block_parsing(spark, sf):
    rows = packets(spark, sf).select("event_id", "`@timestamp`", "`source.ip`", "`destination.ip`", F.concat(
        F.lit("/?a=b="), F.col("`http.host`")).alias("http.request.uri"))
    text = blocks.packet_blocks(rows).select("event_id", blocks.blocks_text(F.col("blocks")).alias("text"))
    parsed = text.select("event_id", F.explode(correlate.parse_blocks(F.col("text"))).alias("b"))
    return parsed.select("event_id", F.col("b.type").alias("type"), F.explode("b.kv").alias("fact", "value"))


@query("correlation_facts", ids="C2", views=CORR_VIEWS, sql="with" + _META_SQL + """
    select ord, ts, frame_number, zeek_uid, src_ip, dst_ip, proto, dns_id, ip_id, tcp_seq from meta""")
def correlation_facts(spark, sf):
    names = ["ts", "frame_number", "zeek_uid", "src_ip", "dst_ip", "proto", "dns_id", "ip_id", "tcp_seq"]
    return correlate.correlation_facts(tagged_blocks(spark, sf)).select("ord", *[f"meta.{x}" for x in names])


@query("correlation_keys", ids="C3", views=CORR_VIEWS, sql="with" + _KEY_SQL + " select * from k")
def correlation_keys(spark, sf):
    return correlated(spark, sf).select("ord", "corr_key", "corr_level", "corr_confidence", "corr_method")


@query("correlation_ids", ids="C4", views=CORR_VIEWS, sql="with" + _KEY_SQL + """
    select distinct corr_key, corr_level || '_' || substring(md5(corr_key), 1, 8) as corr_id from k where corr_key is not null""")
def correlation_ids(spark, sf):
    keys = correlated(spark, sf).select("corr_key", "corr_level").filter(F.col("corr_key").isNotNull()).distinct()
    return keys.select("corr_key", correlate.corr_id(F.col("corr_level"), F.col("corr_key")).alias("corr_id"))


_GROUP_SQL = "with" + _KEY_SQL + """,
      v as (select corr_key, corr_level, corr_confidence, type, fact, arg_min(value, (-length(value), ord)) as value
        from k join facts using (ord) where corr_key is not null group by all),
      b as (select corr_key, corr_level, corr_confidence, type, '[' || type || ']' || chr(10) || string_agg(fact || '=' || value, chr(10) order by fact) as text from v group by corr_key, corr_level, corr_confidence, type),
      g as (select corr_level || '_' || substring(md5(corr_key), 1, 8) as corr_id, corr_key, corr_level, corr_confidence, string_agg(text, chr(10) order by
        case type when 'META' then 1 when 'FLOW' then 2 when 'PROTO:IP' then 3 when 'PROTO:TCP' then 5 when 'PROTO:IDS' then 99 else 50 end, type) as blocks from b group by corr_key, corr_level, corr_confidence)"""


def groups(spark, sf):
    return correlate.merge_groups(correlated(spark, sf, with_text=True), "ord")


@query("correlation_groups", ids="C5", views=CORR_VIEWS, sql=_GROUP_SQL + " select * from g")
def correlation_groups(spark, sf):
    return groups(spark, sf).withColumn("blocks", F.array_join("blocks", "\n"))


@query("correlation_counters", ids="C6", views=CORR_VIEWS, sql="with" + _KEY_SQL + " select corr_method, count(*) as rows from k group by all")
def correlation_counters(spark, sf):
    return correlate.correlation_counters(correlated(spark, sf))


@query("correlation_quality", ids="R10", views=CORR_VIEWS, sql=_GROUP_SQL + """
    select corr_level, corr_confidence, count(*) as groups from g group by all""")
def correlation_quality(spark, sf):
    return correlate.correlation_quality(groups(spark, sf))


# --- validation ------------------------------------------------------------------------------

def faulty_groups(spark, sf):
    """Groups made of the event rows, a share of them with a fault of every kind."""
    e = view(spark, sf, "v_events")
    kind = F.col("event_id") % 12
    level = F.when(kind == 0, "session").when(kind == 1, "packet").when(kind == 2, "transaction").otherwise("flow")
    confidence = F.when(kind == 3, "certain").when(kind == 2, "high").otherwise("low")
    key = F.when(kind == 4, "").otherwise(F.concat(F.lit("5tuple="), F.col("si"), F.lit("->"), F.col("di")))
    extra = (
        F.when(kind == 5, "note=").when(kind == 6, "state=None").when(kind == 7, "state=N/A").when(kind == 8, "vlan.id=7")
        .when(kind == 9, "peer=00:11:22:33:44:55").when(kind == 10, "via=the data link switch").when(kind == 11, "no fact here").otherwise("state=SF"))
    body = F.concat(F.lit("[FLOW]\nsrc_ip="), F.col("si"), F.lit("\n"), extra)
    second = F.when(F.col("event_id") % 24 == 5, F.array(body, F.lit("[META]"))).otherwise(F.array(body))
    return e.select(F.concat(F.lit("flow_"), F.col("event_id").cast("string")).alias("corr_id"), level.alias("corr_level"),
                    key.alias("corr_key"), confidence.alias("corr_confidence"), second.alias("blocks"))


_FAULTS = "select 'flow_' || event_id as corr_id, '{check}' as check, '{place}' as place, '{text}' as violation from v_events where event_id % {mod} = {rest}"


def _faults(check, *rows):
    return " union all ".join(_FAULTS.format(check=check, place=place, text=text.replace("'", "''"), mod=mod, rest=rest) for place, text, mod, rest in rows)


_STRUCTURE = _faults("structure", ("group", "Missing corr_key", 12, 4), ("group", "Invalid corr_level 'session'", 12, 0),
                     ("group", "Invalid corr_confidence 'certain'", 12, 3), ("block 1 line 3", "Empty value for key 'note'", 12, 5),
                     ("block 1 line 3", "Invalid format", 12, 11))
_HYGIENE = _faults("hygiene", ("block 2", "Empty block", 24, 5), ("block 1 line 3", "Empty value for key 'note'", 12, 5),
                   ("block 1 line 3", "Null value for key 'state'", 12, 6), ("block 1 line 3", "Placeholder token for key 'state'", 12, 7))
_LAYER = _faults("layer", ("block 1 line 3", "L1/L2 artifact in key 'vlan.id'", 12, 8),
                 ("block 1 line 3", "MAC address detected in value of 'peer'", 12, 9),
                 ("block 1 line 3", "L1/L2 reference in value of 'via'", 12, 10))
_CONSISTENCY = _faults("consistency", ("group", "packet level without a packet-level key", 12, 1),
                       ("group", "transaction level without a transaction identifier", 12, 2),
                       ("group", "transaction level with confidence 'high'", 12, 2), ("group", "flow level without a flow identifier", 12, 4))


@query("structure_check", ids="V1", views="v_events", sql=_STRUCTURE)
def structure_check(spark, sf):
    return validate.structure_violations(faulty_groups(spark, sf))


@query("hygiene_check", ids="V2", views="v_events", sql=_HYGIENE)
def hygiene_check(spark, sf):
    return validate.hygiene_violations(faulty_groups(spark, sf))


@query("layer_check", ids="V3", views="v_events", sql=_LAYER)
def layer_check(spark, sf):
    return validate.layer_violations(faulty_groups(spark, sf))


@query("consistency_check", ids="V4", views="v_events", sql=_CONSISTENCY)
def consistency_check(spark, sf):
    return validate.consistency_violations(faulty_groups(spark, sf))


@query("validation_gate_faulty", ids="V5", views="v_events", sql=f"""
    with v as ({_STRUCTURE} union all {_HYGIENE} union all {_LAYER} union all {_CONSISTENCY})
    select 'INVALID' as status, count(*) as violations, (select count(*) from v_events) as groups, cast(null as varchar) as summary from v""")
def validation_gate_faulty(spark, sf):
    return validate.gate(faulty_groups(spark, sf))


@query("validation_violations", ids="V5", views="v_events", sql=f"{_STRUCTURE} union all {_HYGIENE} union all {_LAYER} union all {_CONSISTENCY}")
def validation_violations(spark, sf):
    return validate.violations(faulty_groups(spark, sf))


@query("validation_gate", ids="V5", views=CORR_VIEWS, sql=_GROUP_SQL + """
    select 'VALID' as status, cast(0 as bigint) as violations, count(*) as groups,
      concat('validation_summary=passed (', count(*), ' CORR_GROUPs validated)') as summary from g""")
def validation_gate(spark, sf):
    return validate.gate(groups(spark, sf))
