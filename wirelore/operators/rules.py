"""Technique rules over the aggregates of one ticket window (N family).

A window is one row, so all rules are expressions of that row: they give an array of technique
structs in rule order, which is then reduced to one entry per technique and ranked in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Input columns (missing or NULL counts are zero): sightings of a log type, and details of it.
COUNT_COLUMNS = """dns_sightings smtp_sightings ssh_sightings rdp_sightings telnet_sightings
    txt_queries null_queries unique_queries nxdomain post_requests get_requests unique_user_agents
    unique_ja3 unique_senders unique_recipients coverage bucket_count""".split()
FLAG_COLUMNS = ["has_dns_details", "has_http_details", "has_tls_details"]
VALUE_COLUMNS = ["top1_share", "bucket_avg", "bucket_variance"]

# Technique names.
NAMES = {
    "T1071.001": "Application Layer Protocol: Web Protocols",
    "T1071.004": "Application Layer Protocol: DNS",
    "T1572": "Protocol Tunneling",
    "T1583.001": "Acquire Infrastructure: Domains",
    "T1573.002": "Encrypted Channel: Asymmetric Cryptography",
    "T1566.002": "Phishing: Spearphishing Link",
    "T1021.004": "Remote Services: SSH",
    "T1021.001": "Remote Services: Remote Desktop Protocol",
    "T1041": "Exfiltration Over C2 Channel",
    "T1571": "Non-Standard Port",
}

# Wording of the reasons in reports.
REASONS = {
    "dns_seen": "DNS queries observed to IOC-related domain (%d sightings)",
    "dns_types": "Unusual DNS query types observed (TXT: %d, NULL: %d) - potential DNS tunneling",
    "dns_many": "High number of unique DNS queries (%d) may indicate DGA or fast-flux behavior",
    "dns_nxdomain": "Elevated NXDOMAIN responses (%d) may indicate DGA probing or stale C2 infrastructure",
    "http_seen": "HTTP traffic to IOC domain (POST: %d, GET: %d) indicates potential C2 communication",
    "http_agents": "Multiple unique User-Agents (%d) may indicate user-agent rotation for evasion",
    "tls_seen": "TLS-encrypted communications to IOC (JA3 fingerprints: %d)",
    "mail_seen": "SMTP traffic involving IOC (%d messages, %d senders, %d recipients) may indicate phishing activity",
    "remote_access": "%s connections involving IOC (%d sightings) may indicate remote access or lateral movement",
    "telnet_seen": "Telnet connections (%d sightings) to IOC indicate cleartext remote access attempt",
    "one_peer": "High concentration of traffic to single peer (%.0f%%) may indicate data exfiltration over C2 channel",
    "many_protocols": "IOC accessed via %d different protocols, indicating multi-channel communication",
    "steady": "Regular temporal pattern detected (avg: %.1f/bucket, variance: %.2f) suggests potential beaconing behavior",
}


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _rule(condition: Column, technique: str, confidence: float, text: str, *values: Column) -> Column:
    why = F.format_string(text, *values) if values else F.lit(text)
    return F.when(condition, F.struct(
        F.lit(technique).alias("technique_id"), F.lit(NAMES[technique]).alias("technique_name"),
        why.alias("justification"), F.lit(confidence).alias("confidence")))


def dns_rules() -> list[Column]:
    """N1."""
    n, detailed = _count("dns_sightings"), _flag("has_dns_details")
    txt, null = _count("txt_queries"), _count("null_queries")
    unique, nx = _count("unique_queries"), _count("nxdomain")
    return [
        _rule(~detailed & (n > 0), "T1071.004", 0.6, REASONS["dns_seen"], n),
        _rule(detailed & ((txt > 5) | (null > 0)), "T1572", 0.75,
              REASONS["dns_types"], txt, null),
        _rule(detailed & (unique > 50), "T1583.001", 0.65,
              REASONS["dns_many"], unique),
        _rule(detailed & (nx > 10), "T1071.004", 0.55,
              REASONS["dns_nxdomain"], nx),
    ]


def web_rules() -> list[Column]:
    """N2."""
    post, get, agents = _count("post_requests"), _count("get_requests"), _count("unique_user_agents")
    return [
        _rule(_flag("has_http_details") & (post > 0), "T1071.001", 0.7,
              REASONS["http_seen"], post, get),
        _rule(_flag("has_http_details") & (agents > 5), "T1071.001", 0.6,
              REASONS["http_agents"], agents),
        _rule(_flag("has_tls_details"), "T1573.002", 0.65,
              REASONS["tls_seen"], _count("unique_ja3")),
    ]


def mail_rules() -> list[Column]:
    """N3."""
    n = _count("smtp_sightings")
    return [_rule(n > 0, "T1566.002", 0.6,
                  REASONS["mail_seen"],
                  n, _count("unique_senders"), _count("unique_recipients"))]


def remote_access_rules() -> list[Column]:
    """N4."""
    ssh, rdp, telnet = _count("ssh_sightings"), _count("rdp_sightings"), _count("telnet_sightings")
    lateral = REASONS["remote_access"]
    return [
        _rule(ssh > 0, "T1021.004", 0.6, lateral, F.lit("SSH"), ssh),
        _rule(rdp > 0, "T1021.001", 0.65, lateral, F.lit("RDP"), rdp),
        _rule(telnet > 0, "T1021.004", 0.7,
              REASONS["telnet_seen"], telnet),
    ]


def exfiltration_rules() -> list[Column]:
    """N5."""
    share = F.coalesce(F.col("top1_share"), F.lit(0.0))
    coverage = _count("coverage")
    return [
        _rule(share > 0.8, "T1041", 0.55,
              REASONS["one_peer"], share * 100),
        _rule(coverage >= 3, "T1071.001", 0.5,
              REASONS["many_protocols"], coverage),
    ]


def temporal_rules() -> list[Column]:
    """N6; mean and population variance are those of the non-empty buckets."""
    avg, variance = F.col("bucket_avg"), F.col("bucket_variance")
    steady = (_count("bucket_count") >= 3) & (variance < avg * 0.5) & (avg > 1)
    return [_rule(F.coalesce(steady, F.lit(False)), "T1571", 0.6,
                  REASONS["steady"],
                  avg, variance)]


def all_rules() -> list[Column]:
    return dns_rules() + web_rules() + mail_rules() + remote_access_rules() + exfiltration_rules() + temporal_rules()


def ranked(rules: Column, limit: int = 6) -> Column:
    """First entry per technique, by confidence, at most ``limit``."""
    seen_before = lambda x, i: F.exists(F.slice(rules, 1, i), lambda y: y["technique_id"] == x["technique_id"])
    unique = F.filter(rules, lambda x, i: ~seen_before(x, i))
    numbered = F.transform(unique, lambda x, i: F.struct((-x["confidence"]).alias("rank"), i.alias("ord"), x.alias("ttp")))
    return F.transform(F.slice(F.array_sort(numbered), 1, limit), lambda x: x["ttp"])


def map_techniques(windows: DataFrame, limit: int = 6) -> DataFrame:
    """Add ``observed_ttps`` to each ticket window."""
    defaults = {name: kind for names, kind in ((COUNT_COLUMNS, "long"), (FLAG_COLUMNS, "boolean"), (VALUE_COLUMNS, "double")) for name in names}
    missing = {n: F.lit(None).cast(kind) for n, kind in defaults.items() if n not in windows.columns}
    padded = windows.withColumns(missing) if missing else windows
    hits = padded.withColumn("_rules", F.filter(F.array(*all_rules()), lambda r: r.isNotNull()))
    return hits.withColumn("observed_ttps", ranked(F.col("_rules"), limit)).drop("_rules", *missing)
