"""Address, port and flow-id expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import c

# Addresses and names that stand for "no address".
NULL_ADDRESSES = ["0.0.0.0", "::", "", "N/A", "unknown"]

IPV4_PATTERN = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"

# IPv4 networks that are not globally routed (IANA special-purpose registry).
PRIVATE_NETWORKS = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 29),
    ("192.0.0.170", 31),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]

# IANA protocol numbers used in flow ids.
PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17, "icmp6": 58, "ipv6-icmp": 58, "sctp": 132}
PORT_PROTOCOLS = [6, 17, 132]

NO_FLOW_ID = "none"


def clean_address(col: Column) -> Column:
    """Placeholder addresses become NULL."""
    return F.when(~F.trim(col).isin(NULL_ADDRESSES), F.trim(col))


def clean_port(col: Column) -> Column:
    """Port 0 becomes NULL."""
    return F.when(col != 0, col)


def is_ipv4(col: Column) -> Column:
    return F.coalesce(col.rlike(IPV4_PATTERN), F.lit(False))


def _ipv4_hex(col: Column) -> Column:
    octet = lambda part: F.lpad(F.lower(F.hex(part.try_cast("int"))), 2, "0")
    return F.when(is_ipv4(col), F.array_join(F.transform(F.split(col, "[.]"), octet), ""))


def ipv4_number(col: Column) -> Column:
    """Dotted quad as a BIGINT, NULL for anything else."""
    return F.conv(_ipv4_hex(col), 16, 10).cast("long")


def _quad(address: str) -> int:
    number = 0
    for part in address.split("."):
        number = number * 256 + int(part)
    return number


def is_private(col: Column) -> Column:
    """True for private, loopback and link-local addresses of either family."""
    number = ipv4_number(col)
    inside = F.lit(False)
    for network, bits in PRIVATE_NETWORKS:
        low = _quad(network)
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
    v6 = col.contains(":") & F.lower(col).rlike(r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")
    return F.coalesce(inside, F.lit(False)) | F.coalesce(v6, F.lit(False))


def _ipv6_hex(col: Column) -> Column:
    halves = F.split(F.lower(col), "::", 2)
    left = F.filter(F.split(halves[0], ":"), lambda g: g != "")
    right = F.when(
        F.size(halves) > 1, F.filter(F.split(F.try_element_at(halves, F.lit(2)), ":"), lambda g: g != "")
    ).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.when((F.size(halves) > 1) & (gap > 0), F.array_repeat(F.lit("0"), gap)).otherwise(
        F.array().cast("array<string>")
    )
    groups = F.concat(left, zeros, right)
    valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(valid, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def address_hex(col: Column) -> Column:
    """Network-order bytes of an address as hex; NULL when it is not an address."""
    return F.when(col.contains(":"), _ipv6_hex(col)).otherwise(_ipv4_hex(col))


def protocol_number(transport: Column) -> Column:
    name = F.lower(F.trim(transport))
    chain = None
    for label, number in PROTOCOL_NUMBERS.items():
        chain = F.when(name == label, number) if chain is None else chain.when(name == label, number)
    return chain.otherwise(name.try_cast("int"))


def add_flow_id(
    df: DataFrame, src: str, dst: str, sport: str, dport: str, transport: str, name: str, seed: int = 0
) -> DataFrame:
    """Direction-independent flow id, Community ID version 1 (P7); ``none`` without two addresses.

    The address bytes are a projection of their own, so they are computed once per row.
    """
    staged = df.withColumns({
        "_a": address_hex(c(src)),
        "_b": address_hex(c(dst)),
        "_proto": protocol_number(c(transport)),
        "_sp": F.coalesce(c(sport).try_cast("int"), F.lit(0)),
        "_dp": F.coalesce(c(dport).try_cast("int"), F.lit(0)),
    })
    a, b, proto, sp, dp = (F.col(x) for x in ("_a", "_b", "_proto", "_sp", "_dp"))
    staged = staged.withColumn("_forward", (a < b) | ((a == b) & (sp <= dp)))
    forward = F.col("_forward")
    port_hex = lambda p: F.lpad(F.lower(F.hex(p)), 4, "0")
    ports = F.when(forward, F.concat(port_hex(sp), port_hex(dp))).otherwise(F.concat(port_hex(dp), port_hex(sp)))
    body = F.concat(
        F.lit(f"{seed:04x}"),
        F.when(forward, F.concat(a, b)).otherwise(F.concat(b, a)),
        F.lpad(F.lower(F.hex(proto)), 2, "0"),
        F.lit("00"),
        F.when(proto.isin(PORT_PROTOCOLS), ports).otherwise(F.lit("")),
    )
    usable = (F.length(a) == F.length(b)) & proto.between(0, 255) & sp.between(0, 65535) & dp.between(0, 65535)
    digest = F.base64(F.unhex(F.sha1(F.unhex(body))))
    flow_id = F.when(usable, F.concat(F.lit("1:"), digest)).otherwise(F.lit(NO_FLOW_ID))
    return staged.withColumn(name, flow_id).drop("_a", "_b", "_proto", "_sp", "_dp", "_forward")
