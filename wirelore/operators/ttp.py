"""Behaviour patterns of an event set and the techniques they point to (T family, J5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_decimal
from .detect import dns_events, interval_metrics, scan_metrics

# Technique, name, tactic, indicators.
TECHNIQUES = [
    ("T1595", "Active Scanning", "Reconnaissance", ["port_scan", "service_scan"]),
    ("T1071", "Application Layer Protocol", "Command and Control", ["c2_pattern", "beaconing"]),
    ("T1071.001", "Application Layer Protocol: Web Protocols", "Command and Control", ["http_c2", "https_c2"]),
    ("T1071.004", "Application Layer Protocol: DNS", "Command and Control", ["dns_tunneling", "dns_exfil"]),
    ("T1573", "Encrypted Channel", "Command and Control", ["tls_c2", "custom_encryption"]),
    ("T1573.002", "Encrypted Channel: Asymmetric Cryptography", "Command and Control", ["tls_direct_ip", "tls_no_sni"]),
    ("T1046", "Network Service Scanning", "Discovery", ["port_scan", "service_enumeration"]),
    ("T1021", "Remote Services", "Lateral Movement", ["rdp", "ssh", "smb"]),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration", ["dns_exfil", "icmp_exfil"]),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration", ["large_uploads", "sustained_egress"]),
]
REMOTE_PORTS = {"rdp": [3389], "ssh": [22], "smb": [445, 139]}
# The wording of evidence below ("Connection: ", "Beacons: ", ...) is fixed by the reports.


def _pattern(df: DataFrame, names: list[str], evidence: list[Column], confidence: Column) -> DataFrame:
    """Pattern rows (pattern, confidence, evidence) under each of the given names."""
    return df.select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("pattern"), confidence.alias("confidence"),
        F.filter(F.array(*evidence), lambda e: e.isNotNull()).alias("evidence"))


def beaconing_pattern(events: DataFrame, max_cv: float = 0.05, min_events: int = 5, metrics: DataFrame | None = None) -> DataFrame:
    """Every connection with steady intervals."""
    metrics = interval_metrics(events, min_events=min_events) if metrics is None else metrics
    steady = metrics.filter(F.col("cv") < max_cv)
    link = F.concat(F.lit("Connection: "), F.col("si"), F.lit("->"), F.col("di"), F.lit(":"),
                    F.coalesce(F.col("dp").cast("string"), F.lit("None")))
    evidence = [
        link,
        F.format_string("Beacons: %d", "events"),
        F.format_string("Interval: %ss (±%ss)", one_decimal(F.col("interval_avg")), one_decimal(F.col("interval_stddev"))),
        F.format_string("Consistency: %s%%", one_decimal((1 - F.col("cv")) * 100)),
    ]
    return _pattern(steady, ["beaconing", "c2_pattern"], evidence, F.lit("HIGH"))


def scan_pattern(events: DataFrame, ports: int = 20, destinations: int = 10, high_ports: int = 50, min_events: int = 10,
                 metrics: DataFrame | None = None) -> DataFrame:
    """Every source that contacts many ports or hosts."""
    metrics = scan_metrics(events) if metrics is None else metrics
    scans = metrics.filter((F.col("unique_ports") > ports) | (F.col("unique_destinations") > destinations))
    found = scans.filter(events.agg(F.count(F.lit(1))).scalar() >= min_events)
    evidence = [
        F.concat(F.lit("Source: "), F.col("si")),
        F.format_string("Unique destinations: %d", "unique_destinations"),
        F.format_string("Unique ports: %d", "unique_ports"),
    ]
    return _pattern(found, ["port_scan"], evidence, F.when(F.col("unique_ports") > high_ports, "HIGH").otherwise("MEDIUM"))


def dns_pattern(events: DataFrame, min_events: int = 10, length: int = 50, min_long: int = 5) -> DataFrame:
    """Many long DNS names (T3); the earliest is the example."""
    long_name = F.length("dns_query") > length
    found = dns_events(events).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(long_name).alias("long"),
        F.min(F.when(long_name, F.struct("t", "dns_query"))).alias("example"))
    found = found.filter((F.col("n") >= min_events) & (F.col("long") > min_long))
    evidence = [
        F.format_string("Long DNS queries: %d", "long"),
        F.concat(F.lit("Example: "), F.substring("example.dns_query", 1, 60), F.lit("...")),
    ]
    return _pattern(found, ["dns_tunneling", "dns_exfil"], evidence, F.lit("MEDIUM"))


def tls_pattern(events: DataFrame, min_events: int = 3, destinations: int | None = None, fingerprints: int | None = None) -> DataFrame:
    """TLS without a server name (T4): one row per destination, and one for the whole when a number of
    examples is asked for."""
    return _tls_rows(events, min_events) if destinations is None else _tls_summary(events, min_events, destinations, fingerprints or destinations)


def _tls_rows(events: DataFrame, min_events: int) -> DataFrame:
    bare = events.filter((F.col("pr") == "tls") & (F.coalesce("tls_sni", F.lit("")) == "") & F.col("di").isNotNull())
    enough = bare.agg(F.count(F.lit(1))).scalar() > min_events
    per_pair = bare.groupBy("di", "tls_ja3").agg(F.count(F.lit(1)).alias("n")).filter(enough)
    evidence = [
        F.format_string("TLS connections without SNI: %d", "n"), F.concat(F.lit("Destination: "), F.col("di")),
        F.concat(F.lit("JA3 fingerprint: "), F.nullif("tls_ja3", F.lit("")))]
    return _pattern(per_pair, ["tls_no_sni", "tls_direct_ip"], evidence, F.lit("HIGH"))


def _tls_summary(events: DataFrame, min_events: int, destinations: int, fingerprints: int) -> DataFrame:
    bare = events.filter((F.col("pr") == "tls") & (F.coalesce("tls_sni", F.lit("")) == "") & F.col("di").isNotNull())

    def first_values(df: DataFrame, column: str, n: int) -> Column:
        chosen = df.select("t", column).orderBy("t", column).limit(n)
        return chosen.agg(F.array_join(F.sort_array(F.collect_set(column)), ", ")).scalar()

    found = bare.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_events).select(
        "n", first_values(bare, "di", destinations).alias("_di"),
        first_values(bare.filter(F.col("tls_ja3").isNotNull()), "tls_ja3", fingerprints).alias("_ja3"))
    evidence = [
        F.format_string("TLS connections without SNI: %d", "n"),
        F.concat(F.lit("Destinations: "), F.col("_di")),
        F.when(F.col("_ja3") != "", F.concat(F.lit("JA3 fingerprints: "), F.col("_ja3"))),
    ]
    return _pattern(found, ["tls_no_sni", "tls_direct_ip"], evidence, F.lit("HIGH"))


def remote_service_pattern(events: DataFrame, min_events: int = 2) -> DataFrame:
    """RDP, SSH and SMB connections on either port (T5), counted in one pass."""
    used = {name: F.col("dp").isin(ports) | F.coalesce(F.col("sp").isin(ports), F.lit(False)) for name, ports in REMOTE_PORTS.items()}
    row = events.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in used.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in used])
    found = row.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("n") > min_events)
    return found.select(
        F.col("name").alias("pattern"), F.lit("MEDIUM").alias("confidence"),
        F.array(F.concat(F.upper("name"), F.format_string(" connections: %d", "n"))).alias("evidence"))


def detect_patterns(
    events: DataFrame, intervals: DataFrame | None = None, scans: DataFrame | None = None,
    destinations: int | None = None, fingerprints: int | None = None,
) -> DataFrame:
    """All patterns of an event set; ``intervals`` and ``scans`` are metrics that exist already. With ``destinations`` TLS is
    one row with that many examples."""
    out = beaconing_pattern(events, metrics=intervals)
    for part in (scan_pattern(events, metrics=scans), dns_pattern(events), tls_pattern(events, 3, destinations, fingerprints), remote_service_pattern(events)):
        out = out.unionByName(part)
    return out


def technique_table(spark) -> DataFrame:
    """(indicator, technique) pairs of the fixed technique list."""
    rows = [
        (i, indicator, tid, name, tactic)
        for i, (tid, name, tactic, indicators) in enumerate(TECHNIQUES) for indicator in indicators
    ]
    return spark.createDataFrame(rows, "ord int, indicator string, technique_id string, technique_name string, tactic string")


def techniques_of(patterns: DataFrame) -> DataFrame:
    """One technique row per matching indicator."""
    table = technique_table(patterns.sparkSession)
    return patterns.join(table, patterns.pattern == table.indicator).select(
        "technique_id", "technique_name", "tactic", "confidence", "pattern", "evidence")


def techniques_per_tactic(techniques: DataFrame) -> DataFrame:
    """A25."""
    return techniques.groupBy("tactic").agg(F.count(F.lit(1)).alias("techniques"))
