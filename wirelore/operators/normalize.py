"""Raw rows to the two event shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import add_flow_id, clean_address, clean_port
from ..functions.columns import blank_to_null, c, optional
from ..functions.layers import protocol_name, transport_name
from ..schemas import DEEP_PACKET_FIELDS, ECS_SCHEMA, EVENT_SCHEMA, PACKET_FIELDS, SESSION_LOG_FIELDS


def clean_endpoints(df: DataFrame, addresses=("si", "di"), ports=("sp", "dp")) -> DataFrame:
    """Placeholder addresses and ports become NULL."""
    changes = {a: clean_address(c(a)) for a in addresses}
    changes.update({p: clean_port(c(p)) for p in ports})
    return df.withColumns(changes)


def with_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly ``fields``, as text; the missing ones are NULL."""
    present = set(df.columns)
    return df.select([optional(present, f).alias(f) for f in fields])


def align(df: DataFrame, schema=ECS_SCHEMA, default_risk: int = 10) -> DataFrame:
    """Pad to the schema, drop extra columns, reorder, and fill a missing risk (P10)."""
    columns, present = [], set(df.columns)
    for field in schema.fields:
        col = optional(present, field.name, field.dataType.simpleString()).try_cast(field.dataType)
        if field.name == "risk_score":
            col = F.coalesce(col, F.lit(default_risk))
        columns.append(col.alias(field.name))
    return df.select(columns)


def events_from_packets(raw: DataFrame, source_file: str | None = None) -> DataFrame:
    """Packet-field rows to normalised events.

    A row without a time, or whose port, time or status is not a number, is dropped as malformed.
    """
    raw = with_fields(raw, PACKET_FIELDS)
    raw = raw.select([blank_to_null(c(f)).alias(f) for f in PACKET_FIELDS])

    def either(a: str, b: str) -> Column:
        return F.coalesce(c(a), c(b))

    t = c("frame.time_epoch").try_cast("double")
    sport, dport = either("tcp.srcport", "udp.srcport"), either("tcp.dstport", "udp.dstport")
    status = c("http.response.code")
    well_formed = t.isNotNull()
    for number in (sport, dport, status):
        well_formed = well_formed & (number.isNull() | number.try_cast("int").isNotNull())
    known = {
        "t": t,
        "si": clean_address(either("ip.src", "ipv6.src")),
        "sp": clean_port(sport.try_cast("int")),
        "di": clean_address(either("ip.dst", "ipv6.dst")),
        "dp": clean_port(dport.try_cast("int")),
        "pr": F.lower(F.coalesce(c("_ws.col.Protocol"), F.lit("unknown"))),
        "bytes_sent": c("ip.len").try_cast("long"),
        "dns_query": c("dns.qry.name"),
        "dns_response": F.when(c("dns.resp.name").isNotNull(), F.array(c("dns.resp.name"))),
        "http_method": c("http.request.method"),
        "http_host": c("http.host"),
        "http_uri": c("http.request.uri"),
        "http_user_agent": c("http.user_agent"),
        "http_status": status.try_cast("int"),
        "tls_sni": c("tls.handshake.extensions_server_name"),
        "tls_ja3": c("tls.handshake.ja3"),
        "tls_version": c("tls.record.version"),
        "ingestion_time": F.current_timestamp(),
        "source_file": F.lit(source_file).cast("string"),
    }
    return raw.filter(well_formed).select(
        [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    )


def with_ecs_flow_id(df: DataFrame) -> DataFrame:
    return add_flow_id(df, "source.ip", "destination.ip", "source.port", "destination.port", "network.transport",
                       "network.community_id")


def ecs_from_packets(raw: DataFrame) -> DataFrame:
    """Deep packet-field rows to ECS events with the default values of that shape."""
    raw = with_fields(raw, DEEP_PACKET_FIELDS)
    raw = raw.select([F.when(~c(f).isin("", "nan", "None"), c(f)).alias(f) for f in DEEP_PACKET_FIELDS])

    def number(name: str, kind: str = "int") -> Column:
        return c(name).try_cast(kind)

    def filled(default: int, *names: str, kind: str = "int") -> Column:
        return F.coalesce(*[number(n, kind) for n in names], F.lit(default).cast(kind))

    out = {
        "@timestamp": F.timestamp_micros(F.floor(number("frame.time_epoch", "double") * 1e6).cast("long")),
        "source.ip": F.coalesce(c("ip.src"), c("ipv6.src"), F.lit("unknown")),
        "source.port": filled(0, "tcp.srcport", "udp.srcport"),
        "destination.ip": F.coalesce(c("ip.dst"), c("ipv6.dst"), F.lit("unknown")),
        "destination.port": filled(0, "tcp.dstport", "udp.dstport"),
        "network.ttl": filled(0, "ip.ttl", "ipv6.hlim"),
        "network.protocol": protocol_name(c("_ws.col.Protocol"), c("frame.protocols")),
        "network.transport": transport_name(c("tcp.srcport")),
        "network.bytes": filled(0, "frame.len", kind="long"),
        "duration": F.lit(0.0),
        "risk_score": F.lit(10),
        "data.source": F.lit("tshark"),
        "osi_stack": c("frame.protocols"),
        "tcp.flags": c("tcp.flags.str"),
        "url.domain": F.coalesce(c("http.host"), c("tls.handshake.extensions_server_name")),
        "dns.question.name": c("dns.qry.name"),
        "tls.client.server_name": c("tls.handshake.extensions_server_name"),
        "user_agent.original": c("http.user_agent"),
        "http.content_type": c("http.content_type"),
        "http.request.method": c("http.request.method"),
        "http.response.status_code": filled(0, "http.response.code"),
        "dns.question.type": c("dns.qry.type"),
        "dns.answers": c("dns.resp.name"),
        "tls.handshake.ja3": c("tls.handshake.ja3"),
        "tls.handshake.ciphersuite": c("tls.handshake.ciphersuite"),
        "icmp.type": filled(-1, "icmp.type"),
        "icmp.code": filled(-1, "icmp.code"),
        "tcp.seq": filled(0, "tcp.seq", kind="long"),
        "tcp.ack": filled(0, "tcp.ack", kind="long"),
        "tcp.window_size_value": filled(0, "tcp.window_size_value"),
        "tls.record.version": c("tls.record.version"),
        "icmp.ident": filled(0, "icmp.ident"),
        "dhcp.option.hostname": c("dhcp.option.hostname"),
        "ssh.protocol": c("ssh.protocol"),
        "smb.cmd": c("smb.cmd"),
        "ftp.request.command": c("ftp.request.command"),
        "_ws.col.info": c("_ws.col.info"),
    }
    return with_ecs_flow_id(raw.select([col.alias(name) for name, col in out.items()]))


def ecs_from_sessions(log: DataFrame) -> DataFrame:
    """Session-log rows to ECS events; bytes are both directions with NULL as 0."""
    log = with_fields(log, SESSION_LOG_FIELDS)

    def size(name: str) -> Column:
        return F.coalesce(c(name).try_cast("double").cast("long"), F.lit(0).cast("long"))

    out = {
        "@timestamp": F.timestamp_micros(F.floor(c("ts").try_cast("double") * 1e6).cast("long")),
        "source.ip": c("id.orig_h"),
        "source.port": c("id.orig_p").try_cast("int"),
        "destination.ip": c("id.resp_h"),
        "destination.port": c("id.resp_p").try_cast("int"),
        "network.protocol": F.upper(c("service")),
        "network.transport": F.lower(F.coalesce(c("proto"), F.lit("tcp"))),
        "network.bytes": size("orig_bytes") + size("resp_bytes"),
        "duration": c("duration").try_cast("double"),
        "data.source": F.lit("zeek"),
        "risk_score": F.lit(10),
    }
    return align(with_ecs_flow_id(log.select([col.alias(name) for name, col in out.items()])))
