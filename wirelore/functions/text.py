"""Text measures: entropy, previews, name parts, placeholder tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bound

# Tokens that stand for "no value".
PLACEHOLDERS = ["", "-", "N/A", "unknown", "null", "none"]


def string_entropy(col: Column) -> Column:
    """Shannon entropy (bits per character); 0 for a missing or empty string.

    The characters are sorted once and cut into runs of equal ones, so a text is gone through once however many distinct
    characters it has.
    """

    def bits(text: Column, total: Column) -> Column:
        ordered = F.array_join(F.sort_array(F.split(text, "")), "")
        runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), 0)
        shares = F.transform(runs, lambda run: F.length(run) / total)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    entropy = bound(col, lambda text: bound(F.length(text).cast("double"), lambda total: bits(text, total)))
    return F.when(F.length(col) > 0, entropy).otherwise(F.lit(0.0))


def one_decimal(col: Column) -> Column:
    """A number with one decimal as C and Python write it: its exact binary value is rounded, ties go to the even digit.

    ``format_string`` rounds the shortest decimal text of the number half up, which turns 0.25 and 0.35 (just below it) into 0.3 and 0.4.
    """
    base = 59  # bits behind the point; ten times that fits a long, and numbers next to a tie have no further bits

    def exact(size: Column) -> Column:
        whole = F.floor(size)
        tenths = ((size - whole) * F.lit(2.0 ** base)).cast("long") * 10
        digit, rest = F.shiftright(tenths, base), tenths.bitwiseAND(F.lit((1 << base) - 1))
        half = F.lit(1 << (base - 1))
        up = (rest > half) | ((rest == half) & (digit % 2 == 1))
        shown = whole * 10 + digit + up.cast("long")
        return F.concat(F.floor(shown / 10).cast("string"), F.lit("."), (shown % 10).cast("string"))

    size = F.abs(col)
    text = F.concat(F.when(col < 0, F.lit("-")).otherwise(F.lit("")), exact(size))
    return F.when(size < 1e14, text).otherwise(F.format_string("%.1f", col))


def value_entropy(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Shannon entropy of the values of each group.

    Two partial aggregations, so that one very large group is never gathered as a list:
    H = log2(n) - sum(k * log2 k) / n.
    """
    weights = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    per_value = df.groupBy(*keys, value).agg(weights.alias("_k"))
    n = F.sum("_k")
    return per_value.groupBy(*keys).agg(
        n.alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.log2(n) - F.sum(F.col("_k") * F.log2(F.col("_k").cast("double"))) / n).alias("entropy"),
    )


def payload_entropy(hex_payload: Column) -> Column:
    """Entropy over the bytes of a hex string that may have ``:`` separators, to 4 decimals."""
    digits = F.regexp_replace(hex_payload, ":", "")
    as_text = F.decode(F.unhex(digits), "ISO-8859-1")  # one character per byte
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})+$"), F.round(string_entropy(as_text), 4))


def payload_preview(hex_payload: Column) -> Column:
    digits = F.regexp_replace(hex_payload, ":", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})+$"), F.concat(F.substring(digits, 1, 64), F.lit("...")))


def second_level_label(name: Column) -> Column:
    """The label before the last one, or the name itself when it has no dot."""
    parts = F.split(name, "[.]")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(name)


def preview(col: Column, width: int = 60) -> Column:
    """The first ``width`` characters, marked with ``...`` when cut (P20)."""
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)


def is_mac_address(col: Column) -> Column:
    """P23."""
    return F.trim(col).rlike("^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$")


def meaningful(col: Column) -> Column:
    """False for NULL and for the placeholder tokens."""
    text = F.trim(col.cast("string"))
    return text.isNotNull() & ~F.lower(text).isin([p.lower() for p in PLACEHOLDERS])
