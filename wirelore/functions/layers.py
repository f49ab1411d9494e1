"""OSI layer and protocol-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol names that place a stack on a layer, checked top down.
LAYER_WORDS = [
    (7, ["http", "dns", "tls", "ssh", "smb", "smtp", "ftp", "snmp", "mqtt", "dnp3", "modbus"]),
    (4, ["tcp", "udp", "sctp", "quic"]),
    (3, ["ip", "ipv6", "icmp", "arp"]),
    (2, ["eth", "vlan"]),
]
APPLICATION_PORTS = [20, 21, 22, 23, 25, 53, 80, 110, 123, 143, 161, 443, 587, 993, 995, 3306, 3389, 5432, 5900, 8080, 8443]

# Log table to protocol name.
TABLE_PROTOCOLS = {
    "conn": "TCP/UDP",
    "dns": "DNS",
    "http": "HTTP",
    "ssl": "TLS/SSL",
    "smtp": "SMTP",
    "ssh": "SSH",
    "ftp": "FTP",
    "rdp": "RDP",
    "imap": "IMAP",
    "pop3": "POP3",
    "telnet": "Telnet",
    "netflow": "NetFlow",
    "files": "File Transfer",
    "x509": "X.509",
    "notice": "Notice",
}


def osi_layer(stack: Column, port: Column) -> Column:
    """Layer by stack text, else by destination port, else 3."""
    chain = None
    for layer, words in LAYER_WORDS:
        hit = F.lower(stack).rlike("|".join(words))
        chain = F.when(hit, layer) if chain is None else chain.when(hit, layer)
    return chain.when(port.isin(APPLICATION_PORTS), 7).when(port.between(1, 65535), 4).otherwise(3)


def protocol_name(column_protocol: Column, frame_protocols: Column) -> Column:
    """Upper-case protocol of a packet."""
    shown = F.upper(column_protocol)
    return (
        F.when(shown.isNotNull() & (shown != "DATA"), F.regexp_replace(shown, r"[\[\]]", ""))
        .when(frame_protocols.isNotNull(), F.upper(F.element_at(F.split(frame_protocols, ":"), -1)))
        .otherwise(F.lit("TCP"))
    )


def transport_name(tcp_source_port: Column) -> Column:
    """P5."""
    return F.when(tcp_source_port.isNotNull(), "tcp").otherwise("udp")


def table_protocol(table: Column) -> Column:
    """Protocol name of a log table, by default its name in capitals."""
    pairs = [F.lit(x) for item in TABLE_PROTOCOLS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), table), F.upper(table))
