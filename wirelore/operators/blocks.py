"""Rows as typed fact blocks (P24-P28) and log-record aliasing.

A block is ``struct(type, kv)`` with ``kv`` a map of facts; text is only made at a sink.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, computed
from ..functions.text import meaningful

BLOCKS_TYPE = "array<struct<type:string,kv:map<string,string>>>"

# Keys of the two lowest network layers, which never enter a block.
LOW_LAYER_KEY = r"(?i)(^|[._])(eth|ethernet|arp|mac|vlan|l1|l2|physical)([._]|$)"

# Log-record aliases.
LOG_ALIASES = {
    "timestamp": "t", "src_ip": "si", "dst_ip": "di", "name": "n", "message": "m", "level": "l", "protocol": "pr",
}


def as_text(col: Column, dtype: str) -> Column:
    """Fact text; times are written in ISO form."""
    if dtype.startswith("timestamp"):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return col.cast("string")


class RowFacts:
    """Access to the columns of a row source by name, absent ones being NULL."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def get(self, *names: str) -> Column:
        """The first of the named columns that has a usable value."""
        found = []
        for name in names:
            if name in self.types:
                text = as_text(c(name), self.types[name])
                found.append(F.when(meaningful(text), text))
        return F.coalesce(*found) if found else F.lit(None).cast("string")


Part = tuple[Column | str, Mapping[str, Column]]


def filled(part: Part) -> Column:
    kind, facts = part
    filled = F.coalesce(*facts.values()).isNotNull()
    return filled if isinstance(kind, str) else kind.isNotNull() & filled


def fact_of(parts: Sequence[Part], kind: str, *keys: str) -> Column:
    """A fact of the last block of a kind, straight from the columns it would be made of."""
    chain = None
    for part in reversed(parts):
        name, facts = part
        values = [F.nullif(facts[k], F.lit("")) for k in keys if k in facts]
        if isinstance(name, str) and name != kind:
            continue
        hit = filled(part) if isinstance(name, str) else F.coalesce(name == kind, F.lit(False)) & filled(part)
        value = F.coalesce(*values) if values else F.lit(None).cast("string")
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(None).cast("string") if chain is None else chain


def staged_facts(df: DataFrame, parts: Sequence[Part]) -> tuple[DataFrame, list[Part]]:
    """The facts as a struct column of their own, worked out once, and the parts in terms of it."""
    fields, staged = [], []
    for i, (kind, facts) in enumerate(parts):
        if not isinstance(kind, str):
            fields.append(kind.alias(f"k{i}"))
        fields.extend(value.alias(f"f{i}_{j}") for j, value in enumerate(facts.values()))
        named = {k: F.col(f"_facts.f{i}_{j}") for j, k in enumerate(facts)}
        staged.append((kind if isinstance(kind, str) else F.col(f"_facts.k{i}"), named))
    return computed(df, "_facts", F.struct(*fields)), staged


def add_blocks(df: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """``blocks`` from staged (type, facts) pairs; a block without facts or without a type is left out."""
    blocks = []
    for part in parts:
        kind, facts = part
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in facts.items()])
        kept = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
        name = F.lit(kind) if isinstance(kind, str) else kind
        blocks.append(F.when(filled(part), F.struct(name.alias("type"), kept.alias("kv"))))
    listed = F.filter(F.array(*blocks), lambda b: b.isNotNull()).cast(BLOCKS_TYPE)
    return computed(df, "blocks", listed).drop("_facts")


def with_blocks(df: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """Add ``blocks`` from (type, facts) pairs."""
    return add_blocks(*staged_facts(df, parts))


def drop_low_layers(df: DataFrame) -> DataFrame:
    """Without the columns that name the two lowest layers."""
    return df.select([c(x) for x in df.columns if not re.search(LOW_LAYER_KEY, x)])


# Packet columns per protocol block; the protocol prefix is dropped from the fact name.
PACKET_BLOCKS = {
    "ip": ["ip.id", "ip.ttl", "ip.len", "ip.flags", "ipv6.flow"],
    "tcp": ["tcp.seq", "tcp.ack", "tcp.flags", "tcp.window_size", "tcp.analysis.initial_rtt", "tcp.analysis.retransmission"],
    "udp": ["udp.length", "udp.checksum"],
    "dns": ["dns.question.name", "dns.qry.type", "dns.flags.response", "dns.id", "dns.answers"],
    "tls": ["tls.handshake.ja3", "tls.client.server_name", "tls.handshake.version", "tls.handshake.ciphersuite"],
    "http": ["http.request.method", "http.response.code", "http.host", "http.user_agent", "http.request.uri"],
}


def packet_parts(df: DataFrame) -> list[Part]:
    """Packet rows: META, FLOW and one block per protocol with facts."""
    row = RowFacts(drop_low_layers(df))
    parts = [
        ("META", {"ts": row.get("@timestamp"), "ts_precise": row.get("frame.time_epoch"), "frame_number": row.get("frame.number")}),
        ("FLOW", {
            "src_ip": row.get("source.ip", "ip.src"), "dst_ip": row.get("destination.ip", "ip.dst"),
            "src_port": row.get("source.port", "tcp.srcport", "udp.srcport"),
            "dst_port": row.get("destination.port", "tcp.dstport", "udp.dstport"), "proto": row.get("network.transport", "ip.proto")}),
    ]
    for protocol, columns in PACKET_BLOCKS.items():
        kind = f"PROTO:{protocol.upper()}"
        if protocol == "ip":
            kind = F.when(row.get("ipv6.flow").isNotNull(), "PROTO:IPV6").otherwise("PROTO:IP")
        parts.append((kind, {x.removeprefix(f"{protocol}."): row.get(x) for x in columns}))
    return parts


def _protocol_type(name: Column) -> Column:
    """``PROTO:NAME``, NULL for an unusable name."""
    return F.concat(F.lit("PROTO:"), F.upper(name))


def session_parts(df: DataFrame) -> list[Part]:
    """Session-log rows: META with the uid, FLOW with duration and bytes, PROTO:service (P25)."""
    row = RowFacts(df)
    return [
        ("META", {"ts": row.get("ts"), "zeek_uid": row.get("uid")}),
        ("FLOW", {
            "src_ip": row.get("id.orig_h"), "dst_ip": row.get("id.resp_h"), "src_port": row.get("id.orig_p"),
            "dst_port": row.get("id.resp_p"), "proto": row.get("proto"), "duration": row.get("duration"),
            "orig_bytes": row.get("orig_bytes"), "resp_bytes": row.get("resp_bytes")}),
        (_protocol_type(row.get("service")), {
            "service": row.get("service"), "conn_state": row.get("conn_state"), "orig_pkts": row.get("orig_pkts"),
            "resp_pkts": row.get("resp_pkts")}),
    ]


def _ecs_flow(row: RowFacts, **more: Column) -> dict[str, Column]:
    return {
        "src_ip": row.get("source.ip"), "dst_ip": row.get("destination.ip"), "src_port": row.get("source.port"),
        "dst_port": row.get("destination.port"), "proto": row.get("network.transport"), **more}


def alert_parts(df: DataFrame) -> list[Part]:
    """IDS alerts: META, FLOW, PROTO:IDS."""
    row = RowFacts(df)
    return [
        ("META", {"ts": row.get("@timestamp"), "alert_id": row.get("alert_id")}),
        ("FLOW", _ecs_flow(row)),
        ("PROTO:IDS", {
            "alert_id": row.get("alert_id"), "alert_message": row.get("alert.message"),
            "signature_id": row.get("alert.signature_id"), "severity": row.get("alert.severity"), "risk_score": row.get("risk_score")}),
    ]


def fused_parts(df: DataFrame) -> list[Part]:
    """Fused sightings: META with the flow id, FLOW with bytes, one protocol block, IDS if there was an alert."""
    row = RowFacts(df)
    protocol, alert = row.get("network.protocol"), row.get("alert_id")
    return [
        ("META", {"ts": row.get("@timestamp"), "community_id": row.get("network.community_id")}),
        ("FLOW", _ecs_flow(row, bytes=row.get("network.bytes"))),
        (_protocol_type(protocol), {
            "protocol": protocol, "risk_score": row.get("risk_score"), "osi_stack": row.get("osi_stack"),
            "dns_query": row.get("dns.question.name"), "tls_sni": row.get("tls.client.server_name"), "ja3": row.get("tls.handshake.ja3")}),
        (F.when(alert.isNotNull(), "PROTO:IDS"), {"alert_id": alert, "mitre_attack": row.get("mitre_attack")}),
    ]


def packet_blocks(df: DataFrame) -> DataFrame:
    return with_blocks(df, packet_parts(df))


def session_blocks(df: DataFrame) -> DataFrame:
    return with_blocks(df, session_parts(df))


def alert_blocks(df: DataFrame) -> DataFrame:
    return with_blocks(df, alert_parts(df))


def fused_blocks(df: DataFrame) -> DataFrame:
    return with_blocks(df, fused_parts(df))


PARTS = {"tshark": packet_parts, "zeek": session_parts, "snort": alert_parts, "fused": fused_parts}
TRANSFORMS = {"tshark": packet_blocks, "zeek": session_blocks, "snort": alert_blocks, "fused": fused_blocks}


def transform_batch(df: DataFrame, source: str) -> DataFrame:
    """Blocks of every row that has any."""
    return TRANSFORMS[source](df).filter(F.size("blocks") > 0)


def transform_counters(df: DataFrame, source: str) -> DataFrame:
    """How many rows were transformed or skipped, and the columns the layer policy removed."""
    low = len(df.columns) - len(drop_low_layers(df).columns) if source == "tshark" else 0
    only_low = low == len(df.columns)
    kept = F.size("blocks") > 0
    return TRANSFORMS[source](df).agg(
        F.count_if(kept).alias("transformed"),
        F.count_if(~kept & F.lit(not only_low)).alias("skipped_empty"),
        F.count_if(~kept & F.lit(only_low)).alias("skipped_l1l2"),
    )


def block_text(block_col: Column) -> Column:
    """``[TYPE]`` and one ``key=value`` line per fact in key order."""
    lines = F.transform(F.array_sort(F.map_entries(block_col["kv"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("["), block_col["type"], F.lit("]"))), lines), "\n")


def blocks_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, block_text), "\n")


def collapse_log(df: DataFrame, aliases: Mapping[str, str] = LOG_ALIASES, count: str = "dc") -> DataFrame:
    """Short field names, blank values dropped, equal records collapsed with a count."""
    renamed = df.select([
        F.when(meaningful(c(x)), c(x).cast("string")).alias(aliases.get(x, x)) for x in df.columns])
    return renamed.groupBy(*renamed.columns).agg(F.count(F.lit(1)).alias(count))
