"""Fixed schemas and field lists. Field names and their order are data contracts."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

_TYPES = {
    "string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(),
    "timestamp": TimestampType(), "strings": ArrayType(StringType()),
}


def _struct(spec: str) -> StructType:
    fields = []
    for item in spec.split():
        name, _, kind = item.rpartition(":")
        fields.append(StructField(name, _TYPES[kind], True))
    return StructType(fields)


# Normalised network event.
EVENT_SCHEMA = _struct(
    """t:double si:string sp:int di:string dp:int pr:string
    bytes_sent:long bytes_recv:long packets_sent:long packets_recv:long duration:double
    dns_query:string dns_response:strings
    http_method:string http_host:string http_uri:string http_user_agent:string http_status:int
    tls_sni:string tls_ja3:string tls_version:string
    zeek_uid:string zeek_service:string zeek_conn_state:string
    alert_sid:int alert_msg:string alert_priority:int alert_class:string
    ingestion_time:timestamp source_file:string"""
)

# Cross-tool event with ECS-style names.
ECS_SCHEMA = _struct(
    """@timestamp:timestamp source.ip:string source.port:int destination.ip:string destination.port:int
    network.protocol:string network.transport:string network.bytes:long duration:double risk_score:int
    alert_id:string alert.message:string data.source:string enrichment:string
    osi_stack:string network.community_id:string network.ttl:int tcp.flags:string url.domain:string
    dns.question.name:string tls.client.server_name:string user_agent.original:string http.content_type:string
    http.request.method:string http.response.status_code:int dns.question.type:string dns.answers:string
    tls.handshake.ja3:string tls.handshake.ciphersuite:string icmp.type:int icmp.code:int
    tcp.seq:long tcp.ack:long tcp.window_size_value:int tls.record.version:string icmp.ident:int
    tcp.options.timestamp.tsval:long dhcp.option.hostname:string dhcp.option.dhcp_server_id:string
    ssh.protocol:string smb.cmd:string ftp.request.command:string"""
)

TICKET_SCHEMA = _struct(
    """ticket_id:string ioc_type:string ioc_value:string trigger_type:string created_at:timestamp
    window_start:timestamp window_end:timestamp verdict:string severity:string confidence:double
    tp_count:int fp_count:int historical_threat_ratio:double report_path:string report_generated:timestamp"""
)
IOC_SCHEMA = _struct(
    """ioc_type:string ioc_value:string first_seen:timestamp last_seen:timestamp sightings:long
    threat_score:double sources:strings"""
)
TTP_SCHEMA = _struct(
    """technique_id:string technique_name:string tactic:string confidence:string
    evidence:strings mitigations:strings"""
)
ASSET_SCHEMA = _struct(
    """ip_address:string hostname:string asset_type:string importance:string owner:string
    tenant_id:string last_seen:timestamp"""
)
REPUTATION_SCHEMA = _struct(
    "indicator:string reputation_score:int source:string threat_type:string last_updated:timestamp"
)

# Packet-field export, 26 text columns.
PACKET_FIELDS = """frame.time_epoch ip.src ipv6.src ip.dst ipv6.dst ip.proto ip.len
    tcp.srcport udp.srcport tcp.dstport udp.dstport tcp.flags.str tcp.len udp.length _ws.col.Protocol
    dns.qry.name dns.qry.type dns.resp.name
    http.request.method http.host http.request.uri http.user_agent http.response.code
    tls.handshake.extensions_server_name tls.handshake.ja3 tls.record.version""".split()

# Deep packet-field export, 38 text columns.
DEEP_PACKET_FIELDS = """frame.time_epoch ip.src ipv6.src tcp.srcport udp.srcport
    ip.dst ipv6.dst tcp.dstport udp.dstport ip.ttl ipv6.hlim tcp.flags.str frame.len
    _ws.col.Protocol frame.protocols http.host http.user_agent http.content_type
    http.request.method http.response.code dns.qry.name dns.qry.type dns.resp.name
    tls.handshake.extensions_server_name tls.handshake.ja3 tls.handshake.ciphersuite tls.record.version
    icmp.type icmp.code icmp.ident tcp.seq tcp.ack tcp.window_size_value _ws.col.info
    dhcp.option.hostname ssh.protocol smb.cmd ftp.request.command""".split()

# Session log columns in file order.
SESSION_LOG_FIELDS = """ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration
    orig_bytes resp_bytes conn_state""".split()


def text_schema(fields: list[str]) -> StructType:
    return StructType([StructField(f, StringType(), True) for f in fields])
