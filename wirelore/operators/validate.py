"""Checks of correlation groups (V family): each gives rows (corr_id, check, place, violation)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_mac_address
from .blocks import LOW_LAYER_KEY
from .correlate import CONFIDENCES, LEVELS

# Tokens and phrases of the rules.
PLACEHOLDER_VALUES = ["-", "N/A", "unknown"]
LOW_LAYER_PHRASES = ["layer 1", "layer 2", "l1", "l2", "physical layer", "data link"]


Check = Callable[[bool], list[tuple[Column, Column, Column]]]


def group_lines(groups: DataFrame) -> DataFrame:
    """Every line of every block with its position, and key and value of fact lines; a group without lines is one row.

    ``first`` marks one row of each group, ``lines`` is the number of lines of the block.
    """
    fields = [c for c in groups.columns if c != "blocks"]
    blocks = groups.select(*fields, F.posexplode_outer("blocks").alias("_b", "_text"))
    split = blocks.select(*fields, "_b", F.split("_text", "\n").alias("_lines"))
    lines = split.select(*fields, "_b", F.size("_lines").alias("lines"), F.posexplode_outer("_lines").alias("_l", "text"))
    header = F.col("text").startswith("[") & F.col("text").endswith("]")
    at = F.instr("text", "=")
    return lines.select(
        *fields, (F.col("_b") + 1).alias("block"), (F.col("_l") + 1).alias("line"), "text", "lines", header.alias("is_header"),
        (F.coalesce("_b", F.lit(0)) + F.coalesce("_l", F.lit(0)) == 0).alias("first"),
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).alias("key"),
        F.when(at > 0, F.trim(F.substring("text", at + 1, F.length("text")))).alias("value"))


def _place() -> Column:
    return F.format_string("block %d line %d", "block", "line")


def _of_group(*found: tuple[Column, str | Column]) -> list[tuple[Column, Column, Column]]:
    return [(F.col("first") & hit, F.lit("group"), F.lit(text) if isinstance(text, str) else text) for hit, text in found]


def _of_line(where: Column, *found: tuple[Column, str | Column]) -> list[tuple[Column, Column, Column]]:
    return [(where & hit, _place(), F.lit(text) if isinstance(text, str) else text) for hit, text in found]


def _about_key(start: str, end: str = "'") -> Column:
    return F.concat(F.lit(start), F.col("key"), F.lit(end))


def structure(strict: bool) -> list[tuple[Column, Column, Column]]:
    """Required fields, allowed levels and confidences, line shape (V1)."""
    def value(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    missing = [(value(x) == "", f"Missing {x}") for x in ("corr_id", "corr_level", "corr_key", "corr_confidence")]
    outside = [(~value(x).isin(allowed), F.concat(F.lit(f"Invalid {x} '"), value(x), F.lit("'"))) for x, allowed in (
        ("corr_level", LEVELS), ("corr_confidence", CONFIDENCES))]
    blank = F.trim("text") == ""
    return _of_group(*missing, *outside) + _of_line(
        ~F.col("is_header"), (blank, "Empty line detected"), (~blank & (F.trim("key") == ""), "Empty key"),
        (~blank & (F.col("value") == ""), _about_key("Empty value for key '")), (~blank & F.col("key").isNull(), "Invalid format"))


def hygiene(strict: bool) -> list[tuple[Column, Column, Column]]:
    """Empty blocks, and empty, null or placeholder values (V2)."""
    empty = ((F.col("line") == 1) & (F.col("lines") <= 1), F.format_string("block %d", "block"), F.lit("Empty block"))
    return [empty, *_of_line(
        (F.col("line") > 1) & F.col("key").isNotNull(), (F.col("value") == "", _about_key("Empty value for key '")),
        (F.lower("value").isin("null", "none"), _about_key("Null value for key '")),
        (F.col("value").isin(PLACEHOLDER_VALUES), _about_key("Placeholder token for key '")))]


def layer(strict: bool) -> list[tuple[Column, Column, Column]]:
    """Keys, MAC addresses and phrases of the two lowest layers (V3).

    Phrases count as whole words; ``strict`` also finds them inside other words.
    """
    edge = "" if strict else r"\b"
    phrases = "(?i)" + edge + "(" + "|".join(LOW_LAYER_PHRASES) + ")" + edge
    return _of_line(
        (F.col("line") > 1) & F.col("key").isNotNull(), (F.trim("key").rlike(LOW_LAYER_KEY), _about_key("L1/L2 artifact in key '")),
        (is_mac_address(F.col("value")), _about_key("MAC address detected in value of '")),
        (F.col("value").rlike(phrases), _about_key("L1/L2 reference in value of '")))


def consistency(strict: bool) -> list[tuple[Column, Column, Column]]:
    """Level, key method and confidence must agree (V4)."""
    key, level, confidence = F.lower("corr_key"), F.col("corr_level"), F.col("corr_confidence")

    def has(*terms: str) -> Column:
        hit = F.lit(False)
        for term in terms:
            hit = hit | key.contains(term)
        return hit

    packet, transaction, flow = (level == x for x in LEVELS)
    numbered = has("frame.number=", "pcap_packet_id=")
    derived = key.contains("ts=") & key.contains("5tuple=") & key.contains("ip_id=")
    txid = has("dns_id=", "http_stream=", "tls_handshake=", "txid=")
    five, uid = has("5tuple="), has("zeek_uid=")
    return _of_group(
        (packet & ~(numbered | derived), "packet level without a packet-level key"),
        (packet & numbered & (confidence != "high"), "packet number without confidence 'high'"),
        (packet & derived & ~numbered & (confidence == "high"), "derived packet key with confidence 'high'"),
        (transaction & ~txid, "transaction level without a transaction identifier"),
        (transaction & five & (confidence == "high"), "transaction level with confidence 'high'"),
        (transaction & ~five & (confidence != "low"), "transaction without 5-tuple must have confidence 'low'"),
        (flow & ~(uid | five), "flow level without a flow identifier"),
        (flow & uid & five & ~confidence.isin("medium", "low"), "flow with uid must have confidence 'medium' or 'low'"))


CHECKS: dict[str, Check] = {"structure": structure, "hygiene": hygiene, "layer": layer, "consistency": consistency}


def checked_lines(groups: DataFrame, checks: Sequence[str] = tuple(CHECKS), strict: bool = False) -> DataFrame:
    """corr_id, first and the array ``found`` of (check, place, violation), in one pass over the groups."""
    each = [
        F.when(hit, F.struct(F.lit(name).alias("check"), place.alias("place"), text.alias("violation")))
        for name in checks for hit, place, text in CHECKS[name](strict)]
    return group_lines(groups).select("corr_id", "first", F.filter(F.array(*each), lambda v: v.isNotNull()).alias("found"))


def violations(groups: DataFrame, strict: bool = False, checks: Sequence[str] = tuple(CHECKS)) -> DataFrame:
    """corr_id, check, place and violation of everything that the named checks find."""
    found = checked_lines(groups, checks, strict).select("corr_id", F.explode("found").alias("v"))
    return found.select("corr_id", "v.check", "v.place", "v.violation")


def structure_violations(groups: DataFrame) -> DataFrame:
    return violations(groups, checks=["structure"])


def hygiene_violations(groups: DataFrame) -> DataFrame:
    return violations(groups, checks=["hygiene"])


def layer_violations(groups: DataFrame, strict: bool = False) -> DataFrame:
    return violations(groups, strict, ["layer"])


def consistency_violations(groups: DataFrame) -> DataFrame:
    return violations(groups, checks=["consistency"])


def gate(groups: DataFrame, strict: bool = False) -> DataFrame:
    """One row: status, number of violations and summary (V5). No group at all is a violation.

    Groups and violations are counted in the same pass; ``violations`` lists what was found.
    """
    counted = checked_lines(groups, strict=strict).agg(
        F.count_if("first").alias("groups"), F.coalesce(F.sum(F.size("found").cast("long")), F.lit(0)).alias("found"))
    counted = counted.select((F.col("found") + F.when(F.col("groups") == 0, 1).otherwise(0)).alias("violations"), "groups")
    valid = F.col("violations") == 0
    summary = F.when(valid, F.format_string("validation_summary=passed (%d CORR_GROUPs validated)", "groups"))
    return counted.select(F.when(valid, "VALID").otherwise("INVALID").alias("status"), "violations", "groups", summary.alias("summary"))
