"""The data behind every chart: series, distributions, rankings, graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, epoch_seconds, ratio
from ..functions.layers import osi_layer
from ..functions.text import string_entropy
from ..session import cut_lineage

TS = "@timestamp"


# --- time series -----------------------------------------------------------------------------

def _number(col: Column) -> Column:
    """Numbers as they are; NULL and text count as zero."""
    return F.coalesce(col.cast("string").try_cast("double"), F.lit(0.0))


def _aggregate(agg: str, metric: str | None, exact_type: str | None) -> Column:
    if agg == "count":
        return F.count(F.lit(1) if metric is None else c(metric)).cast("double")
    if agg == "nunique":
        return F.countDistinct(c(metric)).cast("double")
    value = F.coalesce(c(metric), F.lit(0)).cast("double") if exact_type in ("int", "bigint", "double") else _number(c(metric))
    plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return plain[agg](value)


def bucketed(df: DataFrame, aggregates: dict[str, tuple[str, str | None]], ts: str = TS, width: int = 60) -> DataFrame:
    """Aggregates per time bucket of ``width`` seconds, without the empty ones: (bucket, ...).

    ``aggregates`` maps an output name to (aggregate, metric). A median is exact; see ``exact_medians``.
    """
    rows = df.filter(c(ts).isNotNull()).withColumn("_t", epoch_seconds(c(ts)))
    rows = rows.withColumn("bucket", (F.floor(F.col("_t") / width) * width).cast("long"))
    types = dict(df.dtypes)
    medians = {name: metric for name, (agg, metric) in aggregates.items() if agg == "median"}
    plain = [_aggregate(agg, metric, types.get(metric)).alias(name) for name, (agg, metric) in aggregates.items() if agg != "median"]
    out = rows.groupBy("bucket").agg(*plain) if plain else rows.select("bucket").distinct()
    for name, metric in medians.items():
        counted = rows.withColumn("_v", _number(c(metric))).groupBy("bucket", "_v").agg(F.count(F.lit(1)).alias("_k"))
        out = out.join(exact_medians(counted).withColumnRenamed("median", name), "bucket")
    return out


def exact_medians(counted: DataFrame) -> DataFrame:
    """(bucket, median) from counts ``_k`` per (bucket, value ``_v``), whatever the number of a bucket's values.

    The rows are range-partitioned by (bucket, value), which splits a large bucket over tasks. Counts per bucket and
    partition tell which partition holds the middle, and only there running counts pick it. No task gathers a bucket.
    """
    dealt = counted.repartitionByRange("bucket", "_v").withColumn("_slice", F.spark_partition_id())
    placed = cut_lineage(dealt, "median-slices")
    slices = placed.groupBy("bucket", "_slice").agg(F.sum("_k").alias("_rows"))
    in_order = Window.partitionBy("bucket").orderBy("_slice")
    slices = slices.withColumn("_before", F.sum("_rows").over(in_order) - F.col("_rows")).withColumn(
        "_total", F.sum("_rows").over(Window.partitionBy("bucket")))
    lower, upper = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    middle = slices.filter((F.col("_before") <= upper) & (F.col("_before") + F.col("_rows") > lower))
    inside = placed.join(middle, ["bucket", "_slice"])
    end = F.col("_before") + F.sum("_k").over(Window.partitionBy("bucket", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_k"))
    at = lambda place: F.max(F.when((F.col("_start") <= place) & (F.col("_end") > place), F.col("_v")))
    return ranked.groupBy("bucket").agg((at(lower) * 0.5 + at(upper) * 0.5).alias("median"))


def time_series(df: DataFrame, aggregates: dict[str, tuple[str, str | None]], ts: str = TS, width: int = 60) -> DataFrame:
    """Resampled series with empty buckets as zero (A27, R8): (bucket, one column per aggregate)."""
    filled = bucketed(df, aggregates, ts, width)
    return _spine(filled, width).join(filled, "bucket", "left").fillna(0.0, list(aggregates))


def _spine(filled: DataFrame, width: int, piece: int = 10_000) -> DataFrame:
    """All buckets from the first to the last. The range is cut into pieces first, which are then spread
    over tasks, so one event with a far time makes a long series but no giant row."""
    edges = filled.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).filter("low is not null")
    step = F.lit(width * piece).cast("long")
    pieces = edges.select("high", F.explode(F.sequence("low", "high", step)).alias("start")).repartition("start")
    last = F.least("high", F.col("start") + step - width)
    return pieces.select(F.explode(F.sequence("start", last, F.lit(width).cast("long"))).alias("bucket"))


def bandwidth(df: DataFrame, volume: str = "network.bytes", ts: str = TS, width: int = 60) -> DataFrame:
    """Mbps per bucket."""
    series = bucketed(df, {"total": ("sum", volume)}, ts, width)
    mbps = series.select("bucket", (F.col("total") * 8 / (width * 1e6)).alias("mbps"))
    return _spine(mbps, width).join(mbps, "bucket", "left").fillna(0.0, ["mbps"])


def coverage_gaps(df: DataFrame, ts: str = TS, bucket_seconds: int = 3600) -> DataFrame:
    """Stretches of empty buckets (R6): start of the gap, its end, missing buckets.

    Works on one row per non-empty bucket, which is bounded by the time covered.
    """
    b = F.floor(epoch_seconds(c(ts)) / bucket_seconds).cast("long")
    present = df.filter(c(ts).isNotNull()).select(b.alias("b")).distinct()
    step = present.withColumn("before", F.lag("b").over(Window.orderBy("b")))
    gap = step.filter(F.col("b") - F.col("before") > 1)
    return gap.select(((F.col("before") + 1) * bucket_seconds).alias("gap_start"), (F.col("b") * bucket_seconds).alias("gap_end"),
                      (F.col("b") - F.col("before") - 1).alias("missing_buckets"))


# --- distributions ---------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal bins from minimum to maximum, empty ones included."""
    values = df.filter(c(column).isNotNull()).select(c(column).cast("double").alias("v"))
    edges = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    index = _bin("v", edges, bins)
    counted = values.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counted, "bin", "left").fillna(0, ["events"])


def _bin(column: str, edges: Column, bins: int) -> Column:
    width = edges["high"] - edges["low"]
    return F.when(width > 0, F.least(F.floor((F.col(column) - edges["low"]) * bins / width), F.lit(bins - 1))).otherwise(0).cast("int")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Distribution of a text column."""
    return df.filter(c(column).isNotNull()).groupBy(c(column)).agg(F.count(F.lit(1)).alias("events"))


def ranking(df: DataFrame, category: str, metric: str | None = None, agg: str = "sum", limit: int = 10) -> DataFrame:
    """Top categories by count, sum or maximum (A30); ties by category."""
    value = F.count(F.lit(1)) if metric is None else {"sum": F.sum, "max": F.max}[agg](c(metric))
    grouped = df.filter(c(category).isNotNull()).groupBy(c(category)).agg(value.alias("value"))
    return grouped.orderBy(F.col("value").desc_nulls_last(), c(category)).limit(limit)


def shares(df: DataFrame, category: str) -> DataFrame:
    """Count and share of each category."""
    counted = category_counts(df, category)
    return counted.withColumn("share", ratio(F.col("events"), counted.agg(F.sum("events")).scalar()))


def hierarchy(df: DataFrame, path: Sequence[str], metric: str) -> DataFrame:
    """Totals of every node of a category tree (A32): the path with NULL below the node, depth, total."""
    rolled = df.rollup(*[c(p) for p in path]).agg(F.sum(c(metric)).alias("total"), F.grouping_id().alias("_g"))
    depth = sum((F.when(F.col("_g").bitwiseAND(1 << i) == 0, 1).otherwise(0) for i in range(len(path))), F.lit(0))
    return rolled.withColumn("depth", depth).drop("_g")


def week_heatmap(df: DataFrame, ts: str = TS) -> DataFrame:
    """Events by day of week and hour."""
    return df.groupBy(F.date_format(c(ts), "EEEE").alias("day"), F.hour(c(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def density(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Counts over a grid of two columns."""
    points = df.filter(c(x).isNotNull() & c(y).isNotNull()).select(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    edges = points.agg(F.struct(*[F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(v) for v in ("x", "y")])).scalar()
    return points.groupBy(_bin("x", edges["x"], bins).alias("x_bin"), _bin("y", edges["y"], bins).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("events"))


def category_volume(df: DataFrame, category: str, metric: str | None) -> DataFrame:
    """A36."""
    value = F.count(F.lit(1)) if metric is None else F.sum(c(metric))
    return df.filter(c(category).isNotNull()).groupBy(c(category)).agg(value.alias("volume"))


def flow_asymmetry(df: DataFrame, source: str, volume: str, limit: int = 15) -> DataFrame:
    """Total, count and mean volume of the largest sources."""
    per_source = df.groupBy(c(source)).agg(
        F.sum(c(volume)).alias("total_bytes"), F.count(c(volume)).alias("event_count"), F.avg(c(volume)).alias("avg_bytes"))
    return per_source.orderBy(F.col("total_bytes").desc(), c(source)).limit(limit)


def entropy_series(df: DataFrame, column: str, ts: str = TS) -> DataFrame:
    """Entropy of a text column over time (A38). Each distinct text is measured once."""
    texts = df.filter(c(column).isNotNull()).groupBy(c(ts).alias("ts"), c(column).alias("text")).agg(F.count(F.lit(1)).alias("events"))
    return texts.withColumn("entropy", string_entropy(F.col("text")))


def port_radar(df: DataFrame, port: str = "destination.port", volume: str = "network.bytes", risk: str = "risk_score") -> DataFrame:
    """A44."""
    return df.groupBy(c(port)).agg(
        F.count(F.lit(1)).alias("frequency"), F.sum(c(volume)).alias("volume"), F.max(c(risk)).alias("risk"))


def points(df: DataFrame, columns: Sequence[str], limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Columns for scatter, multi-axis and timeline charts."""
    chosen = df.select(*[c(x) for x in columns])
    return chosen if limit is None else df.orderBy(*[c(x) for x in order]).limit(limit).select(*[c(x) for x in columns])


# --- layers ----------------------------------------------------------------------------------

def with_layer(df: DataFrame) -> DataFrame:
    return df.withColumn("layer", osi_layer(c("osi_stack"), c("destination.port")))


def layer_timeline(df: DataFrame, ts: str = TS, width: int = 86400) -> DataFrame:
    """Events of the layers 3, 4 and 7 per time bucket of ``width`` seconds."""
    rows = with_layer(df.filter(c(ts).isNotNull())).withColumn("_t", epoch_seconds(c(ts)))
    bucket = (F.floor(F.col("_t") / width) * width).cast("long")
    return rows.groupBy(bucket.alias("bucket")).agg(*[F.count_if(F.col("layer") == x).alias(f"layer_{x}") for x in (3, 4, 7)])


def layer_distribution(df: DataFrame) -> DataFrame:
    """A40."""
    return with_layer(df).groupBy("layer").agg(F.count(F.lit(1)).alias("events"))


# Columns that hold names.
IDENTITY_COLUMNS = ["dns.question.name", "url.domain", "tls.client.server_name", "user_agent.original"]


def top_identities(df: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent names over all name columns."""
    names = F.array(*[c(x) for x in IDENTITY_COLUMNS if x in df.columns])
    rows = df.select(F.explode(names).alias("identity")).filter(F.col("identity").isNotNull())
    counted = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("events"))
    return counted.orderBy(F.col("events").desc(), "identity").limit(limit)


# --- graphs ----------------------------------------------------------------------------------

def pair_counts(df: DataFrame, source: str, target: str) -> DataFrame:
    """A31."""
    rows = df.filter(c(source).isNotNull() & c(target).isNotNull())
    return rows.groupBy(c(source).alias("source"), c(target).alias("target")).agg(F.count(F.lit(1)).alias("value"))


def network_edges(df: DataFrame, source: str, target: str, weight: str | None = None, max_nodes: int = 50) -> DataFrame:
    """Weighted edges between the nodes with the most events.

    The edge list is aggregated first; Spark decides by size how to join it with the chosen nodes.
    """
    w = F.lit(1).cast("long") if weight is None else c(weight)
    rows = df.filter(c(source).isNotNull() & c(target).isNotNull())
    edges = rows.groupBy(c(source).cast("string").alias("source"), c(target).cast("string").alias("target")).agg(
        F.sum(w).alias("weight"), F.count(F.lit(1)).alias("events"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "events")
    top = ends.groupBy("node").agg(F.sum("events").alias("n")).orderBy(F.col("n").desc(), "node").limit(max_nodes).select("node")
    kept = edges.join(top, edges.source == top.node, "left_semi")
    return kept.join(top, kept.target == top.node, "left_semi")


def node_index(edges: DataFrame) -> DataFrame:
    """A dense number from 0 for every node, ordered by (digest prefix, label).

    The prefix cuts the nodes into 4096 even slices. Each slice is numbered by itself and moved by
    the sizes of the slices before it, so the numbering is not one sorted task.
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("label")).distinct()
    nodes = nodes.withColumn("_slice", F.substring(F.md5("label"), 1, 3))
    sizes = nodes.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy("label")) - 1
    return nodes.withColumn("_i", inside).join(offsets, "_slice").select("label", (F.col("_i") + F.col("_offset")).alias("node"))


def sankey_links(df: DataFrame, source: str, target: str) -> DataFrame:
    """Pair counts with node numbers for both ends."""
    pairs = pair_counts(df, source, target)
    index = node_index(pairs)
    left = index.select(F.col("label").alias("source"), F.col("node").alias("source_node"))
    right = index.select(F.col("label").alias("target"), F.col("node").alias("target_node"))
    return pairs.join(left, "source").join(right, "target")
