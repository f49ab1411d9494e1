"""Event-set summaries and the data behind report sections (A18-A26, R family)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, ratio


def counts(df: DataFrame, *keys: str, name: str = "events") -> DataFrame:
    return df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def top_counts(df: DataFrame, key: str, limit: int, name: str = "events") -> DataFrame:
    """The most frequent values of a column; equal counts are ordered by value."""
    present = df.filter(c(key).isNotNull())
    return counts(present, key, name=name).orderBy(F.col(name).desc(), c(key)).limit(limit)


def protocol_distribution(events: DataFrame) -> DataFrame:
    """A1."""
    return counts(events, "pr").orderBy(F.col("events").desc(), "pr")


def with_share(df: DataFrame, value: str, name: str, percent: bool = False) -> DataFrame:
    """Add each row's share of the column total; the total is a scalar subquery."""
    total = df.agg(F.sum(value)).scalar()
    share = ratio(F.col(value), total)
    return df.withColumn(name, share * 100 if percent else share)


def protocol_table(events: DataFrame) -> DataFrame:
    """Protocols with count and percentage (R2)."""
    return with_share(counts(events, "pr"), "events", "percentage", percent=True)


def event_set_summary(events: DataFrame) -> DataFrame:
    """A18."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("si").alias("distinct_sources"),
        F.countDistinct("di").alias("distinct_destinations"),
        F.countDistinct("pr").alias("distinct_protocols"),
    )


def primary_indicator(events: DataFrame) -> DataFrame:
    """The most frequent destination and the time window of all events.

    One partial aggregation by destination; equal counts go to the smallest address.
    """
    per_destination = events.groupBy("di").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    best = F.min(F.when(F.col("di").isNotNull(), F.struct((-F.col("n")).alias("rank"), F.col("di"))))
    return per_destination.agg(
        best.alias("best"), F.min("first").alias("window_start"), F.max("last").alias("window_end"),
    ).select(
        F.lit("ip").alias("ioc_type"), F.col("best.di").alias("ioc_value"),
        (-F.col("best.rank")).alias("sightings"), "window_start", "window_end")


def hour_label(t: Column) -> Column:
    return F.date_format(F.timestamp_micros((t * 1e6).cast("long")), "HH:00")


def volume_by_hour(events: DataFrame) -> DataFrame:
    """Megabytes per hour of day."""
    total = F.coalesce("bytes_sent", F.lit(0)) + F.coalesce("bytes_recv", F.lit(0))
    return events.groupBy(hour_label(F.col("t")).alias("hour")).agg((F.sum(total) / F.lit(1048576.0)).alias("megabytes"))


def risk_by_hour(events: DataFrame, high_from: int = 1) -> DataFrame:
    """High, suspicious and normal events per hour of day."""
    alert = F.col("alert_msg").isNotNull() & (F.col("alert_msg") != "")
    high = alert & (F.coalesce("alert_priority", F.lit(0)) >= high_from)
    return events.groupBy(hour_label(F.col("t")).alias("hour")).agg(
        F.count_if(high).alias("high"),
        F.count_if(alert & ~high).alias("suspicious"),
        F.count_if(~F.coalesce(alert, F.lit(False))).alias("normal"),
    )


def kpis(df: DataFrame, volume: str, risk: str, source: str, high_above: int = 50) -> DataFrame:
    """A26."""
    return df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.sum(c(volume)).alias("total_bytes"),
        F.count_if(c(risk) > high_above).alias("high_risk_events"),
        F.avg(c(risk)).alias("mean_risk"),
        F.countDistinct(c(source)).alias("unique_sources"),
    )


def dashboard_cards(df: DataFrame, volume: str, risk: str, source: str, high_above: int = 50) -> DataFrame:
    """R7."""
    return df.agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(c(source)).alias("unique_sources"),
        F.countDistinct(F.when(c(risk) > high_above, c(source))).alias("high_risk_actors"),
        (F.sum(c(volume)) / F.lit(1e9)).alias("volume_gb"),
    )


def peak_bucket(df: DataFrame, bucket: str, value: str, hours_per_bucket: float, baseline: float) -> DataFrame:
    """The busiest bucket, mean per hour, and percent deviation from a baseline."""
    best = F.min(F.struct((-F.col(value)).alias("rank"), F.col(bucket).alias("bucket")))
    mean = F.avg(value) / F.lit(float(hours_per_bucket))
    return df.agg(best.alias("best"), mean.alias("mean_per_hour")).select(
        F.col("best.bucket").alias("peak_bucket"), (-F.col("best.rank")).alias("peak_events"), "mean_per_hour",
        ((F.col("mean_per_hour") - baseline) / F.lit(float(baseline)) * 100).alias("deviation_percent"))


def indicator_inventory(df: DataFrame, columns: Mapping[str, str], t: str, source: str) -> DataFrame:
    """Every distinct indicator with first and last seen, sightings and tools.

    ``columns`` maps a column to its indicator type. Rows are exploded to (type, value) and
    aggregated map-side, so a hot indicator costs one row per task.
    """
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("indicator_type"), c(name).alias("indicator_value")) for name, kind in columns.items()])
    exploded = df.select(c(t).alias("t"), c(source).alias("source"), F.explode(pairs).alias("i")).select("t", "source", "i.*")
    return exploded.filter(F.col("indicator_value").isNotNull()).groupBy("indicator_type", "indicator_value").agg(
        F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("sightings"),
        F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"))


def record_counts(events: DataFrame) -> DataFrame:
    """Records by category."""
    flow = F.col("si").isNotNull() & F.col("di").isNotNull()
    return events.agg(
        F.count_if(flow).alias("flows"),
        F.count("dns_query").alias("dns"),
        F.count_if(F.col("pr") == "tls").alias("tls"),
        F.count("http_method").alias("http"),
        F.count("alert_msg").alias("ids"),
    )


def field_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled share of each column (R6), one pass over the data."""
    filled = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c(x)).alias(f"f{i}") for i, x in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"f{i}").alias("filled")) for i, x in enumerate(columns)])
    return filled.select("n", F.explode(pairs).alias("p")).select(
        "p.field", "p.filled", ratio(F.col("p.filled"), F.col("n")).alias("completeness"))


def evidence_index(df: DataFrame, category: Column, reference: str, per_category: int) -> DataFrame:
    """The first ``per_category`` event references of each category.

    Spark applies a rank filter of this form as a group limit in every map task before the
    shuffle, so each task sends at most ``per_category`` rows of a category, however large it is.
    """
    rows = df.select(category.alias("category"), c(reference).alias("ref")).filter(F.col("category").isNotNull())
    order = Window.partitionBy("category").orderBy("ref")
    ranked = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= per_category)
    return ranked.select("category", "position", "ref")
