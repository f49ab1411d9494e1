"""Weighted threat scores and the advice derived from them (W family, A47)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT_WEIGHT, HISTORICAL_WEIGHT = 0.75, 0.25


def weighted_score(current: Column, historical: Column) -> Column:
    """75 % current window, 25 % history (W1); a missing history is neutral."""
    return F.lit(CURRENT_WEIGHT) * current + F.lit(HISTORICAL_WEIGHT) * F.coalesce(historical, F.lit(0.5))


def assessment(score: Column, threat: float = 0.70, inconclusive: float = 0.40) -> Column:
    return (
        F.when(score >= threat, "THREAT-CONSISTENT")
        .when(score >= inconclusive, "INCONCLUSIVE")
        .otherwise("FALSE-POSITIVE-CONSISTENT")
    )


def capped(value: Column, full: float) -> Column:
    """value / full, at most 1."""
    return F.least(F.lit(1.0), value / F.lit(float(full)))


def current_window_parts(
    df: DataFrame, events: str, protocols: str, pattern_found: str, alerts: str, volume_threshold: float = 1000
) -> DataFrame:
    """Volume, diversity, pattern and alert scores of the current window and their mean."""
    parts = {
        "volume_score": capped(F.col(events), volume_threshold),
        "diversity_score": capped(F.col(protocols), 5),
        "pattern_score": F.when(F.col(pattern_found), 1.0).otherwise(0.0),
        "alert_score": capped(F.col(alerts), 10),
    }
    mean = sum((F.col(p) for p in list(parts)[1:]), F.col("volume_score")) / F.lit(4.0)
    return df.withColumns(parts).withColumn("current_window_score", mean)


def ticket_score(sightings: Column, protocols: Column, threat_ratio: Column) -> Column:
    """struct(score, assessment, confidence) of a ticket (W2); the score is left unrounded."""
    current = capped(sightings, 100) * 0.5 + capped(protocols, 3) * 0.5
    score = weighted_score(current, threat_ratio)
    verdict = (
        F.when(score > 0.6, "Threat-consistent")
        .when(score < 0.4, "False-positive-consistent")
        .otherwise("Inconclusive")
    )
    confidence = (
        F.when(score > 0.75, "high")
        .when(score > 0.6, "medium")
        .when((score < 0.4) & (score > 0.25), "medium")
        .when(score < 0.4, "high")
        .otherwise("low")
    )
    return F.struct(score.alias("score"), verdict.alias("assessment"), confidence.alias("confidence"))


# Recommended actions.
IMMEDIATE_HIGH = [
    "Block the IOC at perimeter firewall/proxy",
    "Isolate affected assets for forensic analysis",
    "Notify incident response team",
]
IMMEDIATE_MEDIUM = ["Add IOC to monitoring watchlist", "Increase logging for involved assets"]
VALIDATION = [
    "Correlate with endpoint detection logs",
    "Check for related IOCs in threat intelligence feeds",
    "Validate business justification for observed traffic",
]
LONG_TERM_THREAT = ["Update IOC reputation in threat intel platform"]
LONG_TERM = ["Document findings in case management system", "Update detection rules if new patterns identified"]


def _texts(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def recommended_actions(confidence: Column, threat_ratio: Column) -> Column:
    """struct(immediate, validation, long_term) of text lists."""
    immediate = (
        F.when(confidence == "high", _texts(IMMEDIATE_HIGH))
        .when(confidence == "medium", _texts(IMMEDIATE_MEDIUM))
        .otherwise(_texts([]))
    )
    extra = F.when(threat_ratio > 0.5, _texts(LONG_TERM_THREAT)).otherwise(_texts([]))
    return F.struct(
        immediate.alias("immediate"),
        _texts(VALIDATION).alias("validation"),
        F.concat(extra, _texts(LONG_TERM)).alias("long_term"),
    )
