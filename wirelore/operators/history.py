"""Ticket history per indicator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio

KEYS = ("ioc_type", "ioc_value")


def verdict_history(tickets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals by verdict; the threat ratio is 0.5 while nothing is resolved (A2)."""
    tp = F.count_if(F.col("verdict") == "MALICIOUS")
    fp = F.count_if(F.col("verdict") == "BENIGN")
    return tickets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        tp.alias("tp_count"),
        fp.alias("fp_count"),
        F.max("created_at").alias("last_seen"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.5)).alias("threat_ratio"),
    )


def outcome_history(tickets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals by outcome; the ratio stays NULL while nothing is resolved (A3)."""
    threat = F.count_if(F.col("outcome") == "Threat")
    false_positive = F.count_if(F.col("outcome") == "False Positive")
    return tickets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        threat.alias("threat_count"),
        false_positive.alias("false_positive_count"),
        F.round(ratio(threat, threat + false_positive), 4).alias("threat_ratio"),
        F.max("created_at").alias("last_observed_ticket"),
    )


def history_without_self(tickets: DataFrame, keys: Sequence[str] = KEYS, ticket_id: str = "ticket_id") -> DataFrame:
    """Each ticket with the outcome history of the other tickets of its indicator.

    The group totals minus the ticket's own row give the counts, so the joins have one right-hand
    row per indicator and no ticket pairs are formed.
    """
    keys = list(keys)
    order = F.struct("created_at", ticket_id)
    totals = tickets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("outcome") == "Threat").alias("_threat"),
        F.count_if(F.col("outcome") == "False Positive").alias("_fp"),
        F.max(order).alias("_newest"),
    )
    joined = tickets.join(totals, keys, "left")
    is_newest = F.col("_newest")[ticket_id] == F.col(ticket_id)
    runner_up = joined.filter(~is_newest).groupBy(*keys).agg(F.max("created_at").alias("_second"))
    joined = joined.join(runner_up, keys, "left")
    threat = F.col("_threat") - F.when(F.col("outcome") == "Threat", 1).otherwise(0)
    fp = F.col("_fp") - F.when(F.col("outcome") == "False Positive", 1).otherwise(0)
    return joined.withColumns({
        "total_tickets": F.col("_n") - 1,
        "threat_count": threat,
        "false_positive_count": fp,
        "threat_ratio": F.round(ratio(threat, threat + fp), 4),
        "last_observed_ticket": F.when(is_newest, F.col("_second")).otherwise(F.col("_newest")["created_at"]),
    }).drop("_n", "_threat", "_fp", "_newest", "_second")
