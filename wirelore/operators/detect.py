"""Behaviour detectors (D family).

Every detector returns its metrics for all groups with a boolean ``flagged``; a caller who only
wants findings filters on it. Thresholds are keyword arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, ratio
from ..functions.text import preview, second_level_label, string_entropy

CONNECTION = ("si", "di", "dp")


def _known_endpoints(events: DataFrame) -> DataFrame:
    return events.filter(F.col("si").isNotNull() & F.col("di").isNotNull())


def gaps(df: DataFrame, keys: Sequence[str], t: str = "t", slice_seconds: int = 600) -> DataFrame:
    """Counts of the gaps between consecutive times of each key: (keys, gap, n).

    A plain ``lag`` would sort all rows of a key in one task. Here equal times collapse to one row
    with a count (their gaps are zero), ``lag`` runs inside (key, time slice), and the gaps across
    slice borders come from one (first, last) row per slice. A key with a third of the data is
    thereby spread over its time slices.
    """
    keys = list(keys)
    slice_of = F.floor(F.col("_t") / slice_seconds)
    times = df.select(*keys, c(t).alias("_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_n"))
    times = times.withColumn("_slice", slice_of)
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t")
    stepped = times.withColumn("gap", F.col("_t") - F.lag("_t").over(inside))
    both = F.array(
        F.struct(F.col("gap"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(0.0).alias("gap"), (F.col("_n") - 1).alias("n")))
    within = stepped.select(*keys, F.explode(both).alias("g")).select(*keys, "g.gap", "g.n")
    within = within.filter(F.col("gap").isNotNull() & (F.col("n") > 0))
    ends = times.groupBy(*keys, "_slice").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    over_slices = Window.partitionBy(*keys).orderBy("_slice") if keys else Window.orderBy("_slice")
    across = ends.withColumn("gap", F.col("_first") - F.lag("_last").over(over_slices)).filter(F.col("gap").isNotNull())
    return within.unionByName(across.select(*keys, "gap", F.lit(1).cast("long").alias("n")))


def interval_metrics(events: DataFrame, keys: Sequence[str] = CONNECTION, min_events: int = 5) -> DataFrame:
    """Count, mean, deviation, CV and entropy of the inter-arrival times of each connection.

    Gaps are first summed per rounded second and then per key, both with map-side partial sums. The deviation is put
    together from moments: within a second around that second, between seconds around the key's mean, so long steady
    intervals don't lose it as a difference of two squares.
    """
    keys = list(keys)
    off = F.col("gap") - F.col("_second")
    per_second = gaps(_known_endpoints(events), keys).withColumn("_second", F.rint("gap")).groupBy(*keys, "_second").agg(
        F.sum("n").alias("_k"), F.sum(off * F.col("n")).alias("_off"), F.sum(off * off * F.col("n")).alias("_squares"))
    k = F.sum("_k")
    means = per_second.groupBy(*keys).agg(
        k.alias("intervals"),
        (F.sum(F.col("_second") * F.col("_k") + F.col("_off")) / k).alias("interval_avg"),
        (F.log2(k) - F.sum(F.col("_k") * F.log2(F.col("_k").cast("double"))) / k).alias("entropy"),
    )
    mean_off = F.col("_off") / F.col("_k")
    away = F.col("_second") - F.col("interval_avg") + mean_off
    m2 = F.col("_squares") - F.col("_off") * mean_off + F.col("_k") * away * away
    same = [F.col(f"s.{x}").eqNullSafe(F.col(f"m.{x}")) for x in keys]
    spread = per_second.alias("s").join(means.alias("m"), same).groupBy(*[F.col(f"m.{x}") for x in keys], *[
        F.col(f"m.{x}") for x in ("intervals", "interval_avg", "entropy")]).agg(F.greatest(F.sum(m2), F.lit(0.0)).alias("_m2"))
    stats = spread.withColumn("interval_stddev", F.sqrt(F.col("_m2") / F.col("intervals"))).drop("_m2")
    cv = F.when(F.col("interval_avg") > 0, F.col("interval_stddev") / F.col("interval_avg")).otherwise(F.lit(1.0))
    return stats.withColumn("events", F.col("intervals") + 1).withColumn("cv", cv).filter(F.col("events") >= min_events)


def beaconing(
    events: DataFrame, keys: Sequence[str] = CONNECTION, min_events: int = 5, max_cv: float = 0.1,
    max_entropy: float = 1.5, min_interval: float = 1, max_interval: float = 3600, high_cv: float = 0.05,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """Periodic connections (D1). ``metrics`` are the connections' interval metrics where they exist already."""
    metrics = interval_metrics(events, keys, min_events) if metrics is None else metrics
    flagged = (
        (F.col("cv") < max_cv) & (F.col("entropy") < max_entropy)
        & (F.col("interval_avg") > min_interval) & (F.col("interval_avg") < max_interval)
    )
    return metrics.withColumn("confidence", F.when(F.col("cv") < high_cv, "HIGH").otherwise("MEDIUM")).withColumn(
        "flagged", flagged)


def _is_dns() -> Column:
    return (F.col("pr") == "dns") & (F.length("dns_query") > 0)


def dns_events(events: DataFrame) -> DataFrame:
    return events.filter(_is_dns())


def dns_tunnel_queries(
    events: DataFrame, min_length: int = 50, min_entropy: float = 3.5, high_entropy: float = 4.0, min_events: int = 5,
    count: Column | None = None,
) -> DataFrame:
    """Long DNS names with a high entropy (D2); nothing is flagged below ``min_events`` DNS events. ``count`` is their number where it is known."""
    dns = dns_events(events)
    enough = (dns.agg(F.count(F.lit(1))).scalar() if count is None else count) >= min_events
    measured = dns.withColumn("query_length", F.length("dns_query")).withColumn("entropy", string_entropy(F.col("dns_query")))
    flagged = (F.col("query_length") > min_length) & (F.col("entropy") > min_entropy) & enough
    return measured.withColumns({
        "query": preview(F.col("dns_query")),
        "confidence": F.when(F.col("entropy") > high_entropy, "HIGH").otherwise("MEDIUM"),
        "flagged": flagged,
    })


def dns_excess(events: DataFrame, max_queries: int = 20, min_events: int = 5, count: Column | None = None) -> DataFrame:
    """Query counts per second-level label (D3)."""
    dns = dns_events(events)
    enough = (dns.agg(F.count(F.lit(1))).scalar() if count is None else count) >= min_events
    per_label = dns.groupBy(second_level_label(F.col("dns_query")).alias("domain")).agg(F.count(F.lit(1)).alias("query_count"))
    return per_label.withColumn("flagged", (F.col("query_count") > max_queries) & enough)


def scan_metrics(
    events: DataFrame, scan_ports: int = 20, high_ports: int = 50, scan_destinations: int = 15
) -> DataFrame:
    """Distinct ports and destinations per source; port scan (D4) or network scan.

    The distinct counts are aggregated by (source, value) before they are by source, so a scanner
    with a third of the events does not sit in one task.
    """
    per_source = _known_endpoints(events).groupBy("si").agg(
        F.countDistinct("dp").alias("unique_ports"),
        F.countDistinct("di").alias("unique_destinations"),
        F.count(F.lit(1)).alias("connections"),
        F.min("t").alias("_first"),
        F.max("t").alias("_last"),
    )
    kind = F.when(F.col("unique_ports") > scan_ports, "port_scan").when(
        F.col("unique_destinations") > scan_destinations, "network_scan")
    duration = F.col("_last") - F.col("_first")
    return per_source.withColumns({
        "duration": duration,
        "rate_per_second": F.when(duration > 0, F.col("connections") / duration).otherwise(F.lit(0.0)),
        "type": kind,
        "confidence": F.when((kind == "port_scan") & (F.col("unique_ports") > high_ports), "HIGH").otherwise("MEDIUM"),
        "flagged": kind.isNotNull(),
    }).drop("_first", "_last")


def large_transfers(events: DataFrame, keys: Sequence[str] = CONNECTION, threshold: int = 100_000_000) -> DataFrame:
    """Bytes per connection in both directions."""
    sent, received = F.sum(F.coalesce("bytes_sent", F.lit(0))), F.sum(F.coalesce("bytes_recv", F.lit(0)))
    totals = _known_endpoints(events).groupBy(*keys).agg(
        sent.alias("bytes_sent"), received.alias("bytes_recv"), F.count(F.lit(1)).alias("packets"))
    total = F.col("bytes_sent") + F.col("bytes_recv")
    return totals.withColumn("total_bytes", total).withColumn("flagged", total > threshold)


def protocol_excess(events: DataFrame, protocol: str = "icmp", min_count: int = 10, min_share: float = 0.05) -> DataFrame:
    """Count and share of one protocol."""
    n = F.count_if(F.col("pr") == protocol)
    share = ratio(n, F.count(F.lit(1)))
    return events.agg(n.alias("count"), share.alias("share")).select(
        F.lit(protocol).alias("protocol"), "count", (F.col("share") * 100).alias("percentage"),
        F.coalesce((F.col("count") > min_count) & (F.col("share") > min_share), F.lit(False)).alias("flagged"))


def all_detectors(events: DataFrame, min_events: int = 10, intervals: DataFrame | None = None, scans: DataFrame | None = None, **thresholds: dict) -> DataFrame:
    """Findings of every detector in one shape: category, subject, metric, confidence.

    ``thresholds`` maps a detector name to its keyword arguments. Below ``min_events`` events there
    are no findings. ``intervals`` and ``scans`` are interval and scan metrics where they exist already.
    """
    def options(name: str) -> dict:
        return thresholds.get(name, {})

    def shaped(df: DataFrame, category: str, subject: Column, metric: Column, confidence: Column | None = None) -> DataFrame:
        return df.filter("flagged").select(
            F.lit(category).alias("category"), subject.alias("subject"), metric.cast("double").alias("metric"),
            (confidence if confidence is not None else F.lit("MEDIUM")).alias("confidence"))

    link = F.concat(F.col("si"), F.lit("->"), F.col("di"), F.lit(":"), F.coalesce(F.col("dp").cast("string"), F.lit("")))
    scans = scan_metrics(events, **options("scan_metrics")) if scans is None else scans
    # One row of counts for everything that needs one.
    counted = events.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(_is_dns(), F.lit(False))).alias("dns"))).scalar()
    parts = [
        shaped(beaconing(events, metrics=intervals, **options("beaconing")), "beaconing", link, F.col("cv"), F.col("confidence")),
        shaped(dns_tunnel_queries(events, **{"count": counted["dns"], **options("dns_tunnel_queries")}), "dns_tunneling", F.col("query"),
               F.col("entropy"), F.col("confidence")),
        shaped(dns_excess(events, **{"count": counted["dns"], **options("dns_excess")}), "dns_tunneling", F.col("domain"), F.col("query_count")),
        shaped(scans, "port_scans", F.col("si"), F.greatest("unique_ports", "unique_destinations"), F.col("confidence")),
        shaped(large_transfers(events, **options("large_transfers")), "volume_anomalies", link, F.col("total_bytes")),
        shaped(protocol_excess(events, **options("protocol_excess")), "protocol_anomalies", F.col("protocol"), F.col("percentage")),
    ]
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    return findings.filter(counted["n"] >= min_events)


def outliers(
    df: DataFrame, volume: str = "network.bytes", risk: str = "risk_score", limit: float = 3, critical_risk: int = 90,
) -> DataFrame:
    """Z-scores of volume and risk with a description of each deviation.

    Mean and sample deviation are one scalar subquery; the rows themselves are not shuffled.
    """
    stats = df.agg(F.struct(
        F.avg(c(volume)).alias("vm"), F.stddev_samp(c(volume)).alias("vs"),
        F.avg(c(risk)).alias("rm"), F.stddev_samp(c(risk)).alias("rs"),
    )).scalar()

    def z(col: Column, mean: Column, deviation: Column) -> Column:
        return F.when(deviation > 0, (col - mean) / deviation).otherwise(F.lit(0.0))

    scored = df.withColumns({
        "z_score_bytes": z(c(volume), stats["vm"], stats["vs"]), "z_score_risk": z(c(risk), stats["rm"], stats["rs"]),
    })
    zb, zr, level = F.col("z_score_bytes"), F.col("z_score_risk"), F.coalesce(c(risk), F.lit(0))
    described = F.concat_ws(
        ", ",
        F.when(zb > limit, "Volume Outlier (Large)"),
        F.when(zb < -limit, "Volume Outlier (Tiny)"),
        F.when(zr > limit, "Statistical Risk Outlier"),
        F.when(level >= critical_risk, "Critical Risk Signature"),
    )
    flagged = (F.abs(zb) > limit) | (F.abs(zr) > limit) | (level >= critical_risk)
    return scored.withColumn("anomaly_type", F.when(described != "", described).otherwise("Minor Deviation")).withColumn(
        "flagged", F.coalesce(flagged, F.lit(False)))


def time_gaps(df: DataFrame, t: str = "t", min_gap: float = 0.1, limit: int | None = None, slice_seconds: int = 600) -> DataFrame:
    """Pauses longer than ``min_gap`` in the whole event sequence, earliest first.

    A pause cannot lie inside a cell half as wide as ``min_gap``, so each cell is reduced to its
    first and last time before anything is ordered. The ordering is done per time slice, and the
    slice borders are joined through one row per slice.
    """
    cells = df.filter(c(t).isNotNull()).groupBy(F.floor(c(t) / (min_gap / 2)).alias("_cell")).agg(
        F.min(c(t)).alias("_first"), F.max(c(t)).alias("_last"))
    cells = cells.withColumn("_slice", F.floor(F.col("_first") / slice_seconds))
    inside = Window.partitionBy("_slice").orderBy("_first")
    within = cells.select(F.col("_first").alias("t"), F.lag("_last").over(inside).alias("_before"))
    ends = cells.groupBy("_slice").agg(F.min("_first").alias("t"), F.max("_last").alias("_last"))
    across = ends.select("t", F.lag("_last").over(Window.orderBy("_slice")).alias("_before"))
    pauses = within.unionByName(across).select("t", (F.col("t") - F.col("_before")).alias("delta")).filter(F.col("delta") > min_gap)
    ordered = pauses.orderBy("t")
    return ordered if limit is None else ordered.limit(limit)
