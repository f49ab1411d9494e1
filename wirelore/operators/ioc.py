"""Indicator look-ups over log tables and the aggregates of a ticket's time window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, optional, ratio
from ..functions.layers import table_protocol
from ..session import cut_lineage

# Where each kind of indicator is looked for: log table, column, reported field, way of matching.
MATCH_RULES = [
    ("ip", None, "src_ip", "src_ip", "equal"),
    ("ip", None, "dst_ip", "dst_ip", "equal"),
    ("domain", "dns", "query", "dns.query", "suffix"),
    ("domain", "http", "host", "http.host", "suffix"),
    ("domain", "ssl", "server_name", "ssl.server_name", "suffix"),
    ("url", "http", "uri", "http.uri", "contains"),
    ("email", "smtp", "mailfrom", "smtp.mailfrom", "equal"),
    ("email", "smtp", "rcptto", "smtp.rcptto", "contains"),
    ("md5", "files", "md5", "files.md5", "equal"),
    ("sha1", "files", "sha1", "files.sha1", "equal"),
    ("sha256", "files", "sha256", "files.sha256", "equal"),
    ("user_agent", "http", "user_agent", "http.user_agent", "equal"),
]

LOG_COLUMNS = """src_ip dst_ip src_country dst_country query qtype_name rcode_name host uri method status_code
    user_agent server_name version ja3 mailfrom rcptto md5 sha1 sha256""".split()

INDICATOR = ["ioc_type", "ioc_value"]
GRAM = 4


def rules_for(log_type: str, columns: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """The (indicator type, column, field, way) rules whose column this table has."""
    return [
        (kind, column, field, way) for kind, table, column, field, way in MATCH_RULES
        if table in (None, log_type) and column in columns
    ]


def ioc_predicates(ioc_type: str, value: str, log_type: str, columns: Sequence[str]) -> list[tuple[str, Column]]:
    """(matched field, condition) pairs of one indicator on one log table (F2)."""
    out = []
    for kind, column, field, way in rules_for(log_type, columns):
        if kind != ioc_type:
            continue
        condition = c(column) == value
        if way == "suffix":
            condition = condition | c(column).endswith("." + value)
        elif way == "contains":
            condition = c(column).contains(value)
        out.append((field, condition))
    return out


def name_suffixes(name: Column) -> Column:
    """A host name and everything after each of its dots."""
    parts = F.split(name, "[.]")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


LOOKUPS_TYPE = "array<struct<ioc_type:string,way:string,matched_field:string,value:string>>"


def _row_lookups(log_type: str, columns: Sequence[str]) -> Column:
    """The (indicator type, way, field, value) look-ups that a row offers, one per rule."""
    found = [
        F.struct(F.lit(kind).alias("ioc_type"), F.lit(way).alias("way"), F.lit(field).alias("matched_field"), c(column).cast("string").alias("value"))
        for kind, column, field, way in rules_for(log_type, columns)]
    return F.array(*found).cast(LOOKUPS_TYPE)


def stack_logs(logs: Mapping[str, DataFrame]) -> DataFrame:
    """All log tables in one shape with their name as ``log_type``; absent columns are NULL.

    ``_lookups`` carries the look-ups of the row, built per table because the rules depend on the
    columns a table has.
    """
    stacked = None
    for log_type, df in logs.items():
        present = df.columns
        part = df.select(
            F.lit(log_type).alias("log_type"), "ts",
            *[optional(present, name).cast("string").alias(name) for name in LOG_COLUMNS],
            _row_lookups(log_type, present).alias("_lookups"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def _grams(text: Column, length: Column) -> Column:
    """Distinct substrings of ``text`` of one length."""
    last = F.length(text) - length + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length)))


def needle_anchors(needles: DataFrame, text_grams: DataFrame) -> DataFrame:
    """One short substring per needle that a text must contain: the one that occurs in the fewest texts."""
    grams = needles.select(
        "kind", "needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    wanted = grams.select("kind", "gram").distinct()
    seen = text_grams.join(wanted, ["kind", "gram"], "left_semi").groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_best")
    found = grams.join(seen, ["kind", "gram"], "left").groupBy("kind", "needle").agg(best)
    return found.filter("_best.n > 0").select("kind", "needle", F.col("_best.gram").alias("gram"))


def contains_join(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(kind, text, needle) for every needle that occurs in a distinct text of its kind.

    Needles and texts meet on an anchor substring, so only texts that hold the anchor are tested; no text is compared
    with every needle. The anchor is the piece that is rarest in the texts, and a text is known by its number until
    it has met a needle, so its pieces don't carry it along.
    """
    needles = needles.filter(F.length("needle") > 0).distinct()
    numbered = texts.filter(F.length("text") > 0).distinct().withColumn("_id", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered, "searched-texts")
    lengths = needles.agg(F.collect_set(F.least(F.length("needle"), F.lit(GRAM)))).scalar()  # at most GRAM values
    sized = numbered.select("kind", "_id", "text", F.explode(lengths).alias("_length"))
    grams = sized.select("kind", "_id", F.explode(_grams(F.col("text"), F.col("_length"))).alias("gram"))
    met = grams.join(needle_anchors(needles, grams), ["kind", "gram"]).select("_id", "needle")
    return numbered.join(met, "_id").filter(F.col("text").contains(F.col("needle"))).select("kind", "text", "needle")


def within_any_window(logs: Mapping[str, DataFrame], tickets: DataFrame, hours: int = 24) -> dict[str, DataFrame]:
    """Log rows between the first ticket's window start and the last one's end; the bounds are read before the logs are."""
    half = F.make_dt_interval(hours=F.lit(hours))
    low, high = tickets.agg(F.min("t0") - half).scalar(), tickets.agg(F.max("t0") + half).scalar()
    return {name: df.filter((F.col("ts") >= low) & (F.col("ts") <= high)) for name, df in logs.items()}


LOOKUP = ["ioc_type", "way", "value"]
SPREAD = 100_000  # rows of one look-up value that may meet in one task


def _kinds(way: str) -> list[str]:
    return sorted({kind for kind, *_, rule in MATCH_RULES if rule == way})


def _hits(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """(indicator type, way, value, indicator) for every distinct look-up value that an indicator matches."""
    def of(way: str) -> tuple[DataFrame, DataFrame]:
        return values.filter(F.col("way") == way), indicators.filter(F.col("ioc_type").isin(_kinds(way)))

    _, wanted = of("equal")
    equal = wanted.select("ioc_type", F.lit("equal").alias("way"), F.col("ioc_value").alias("value"), "ioc_value").dropna()
    names, wanted = of("suffix")
    suffixes = names.select(*LOOKUP, F.explode_outer(name_suffixes(F.col("value"))).alias("ioc_value"))
    suffix = suffixes.join(wanted, INDICATOR).select(*LOOKUP, "ioc_value")
    texts, wanted = of("contains")
    held = contains_join(texts.select(F.col("ioc_type").alias("kind"), F.col("value").alias("text")),
                         wanted.select(F.col("ioc_type").alias("kind"), F.col("ioc_value").alias("needle")))
    contains = held.select(F.col("kind").alias("ioc_type"), F.lit("contains").alias("way"), F.col("text").alias("value"), F.col("needle").alias("ioc_value"))
    return equal.unionByName(suffix).unionByName(contains)


def sightings(logs: Mapping[str, DataFrame], indicators: DataFrame, spread: int = SPREAD) -> DataFrame:
    """One row per log row, matching field and indicator.

    Indicators first meet the distinct values of the logs: by equality, by host suffix, or through ``contains_join``. The
    log rows then meet the values that were hit in one equi-join, with one look-up per rule, so the suffixes that all names
    share never carry rows. A value with more than ``spread`` rows is dealt to several tasks.
    """
    indicators = indicators.select(INDICATOR).distinct()
    plain = ["log_type", "ts", *LOG_COLUMNS]
    opened = stack_logs(logs).select(*plain, F.explode_outer("_lookups").alias("_l")).select(*plain, "_l.*").filter(F.col("value").isNotNull())
    values = cut_lineage(opened.groupBy(LOOKUP).agg(F.count(F.lit(1)).alias("_n")), "look-ups")
    # At most one value per `spread` look-ups of the logs.
    hot = F.broadcast(values.filter(F.col("_n") > spread).select(*LOOKUP, F.ceil(F.col("_n") / spread).cast("int").alias("_parts")))
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    hits = _hits(values, indicators).join(hot, LOOKUP, "left").select(*LOOKUP, "ioc_value", F.explode(parts).alias("_part"))
    hits = cut_lineage(hits, "hits")  # written, so that a small table is known to be small before rows are shuffled
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("ts", "src_ip", "dst_ip"), F.col("_parts")).cast("int")).otherwise(0)
    dealt = opened.join(hot, LOOKUP, "left").withColumn("_part", part)
    return dealt.join(hits, [*LOOKUP, "_part"]).select(*INDICATOR, "matched_field", *plain)


def in_ticket_windows(found: DataFrame, tickets: DataFrame, hours: int = 24, keep: Sequence[str] = ("ticket_id",)) -> DataFrame:
    """Sightings within ``hours`` of each ticket's trigger time ``t0``, with the ``keep`` columns of the ticket.

    The window is turned into the days it touches, so tickets and sightings of a common indicator
    meet per day and not all with all.
    """
    half = F.make_dt_interval(hours=F.lit(hours))
    windows = tickets.select(*keep, "ioc_type", "ioc_value", (F.col("t0") - half).alias("window_start"),
                             (F.col("t0") + half).alias("window_end"))
    days = F.sequence(F.to_date("window_start"), F.to_date("window_end"), F.make_dt_interval(days=F.lit(1)))
    windows = windows.withColumn("_day", F.explode(days))
    joined = found.withColumn("_day", F.to_date("ts")).join(windows, ["ioc_type", "ioc_value", "_day"])
    return joined.filter(F.col("ts").between(F.col("window_start"), F.col("window_end"))).drop("_day")


def window_aggregate(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sightings, distinct addresses and first / last time per key, table and field (A5)."""
    return found.groupBy(*keys, "log_type", "matched_field").agg(
        F.count(F.lit(1)).alias("sightings"),
        F.countDistinct("src_ip").alias("distinct_src"),
        F.countDistinct("dst_ip").alias("distinct_dst"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def protocol_coverage(aggregate: DataFrame, keys: Sequence[str]) -> DataFrame:
    return aggregate.select(*keys, table_protocol(F.col("log_type")).alias("protocol"), "log_type", "matched_field",
                            "sightings", "distinct_src", "distinct_dst")


def sighting_rollup(aggregate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals by log type and by matched field of the A5 rows, with the overall total."""
    sets = F.array(
        F.struct(F.lit("total").alias("level"), F.lit("all").alias("name")),
        F.struct(F.lit("log_type").alias("level"), F.col("log_type").alias("name")),
        F.struct(F.lit("matched_field").alias("level"), F.col("matched_field").alias("name")),
    )
    return aggregate.withColumn("_g", F.explode(sets)).groupBy(*keys, F.col("_g.level"), F.col("_g.name")).agg(
        F.sum("sightings").alias("sightings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def distinct_addresses(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct source and destination addresses (A7); no cap."""
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip")),
        F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")),
    )
    rows = found.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", "s.ip")
    return rows.filter(F.length("ip") > 0).distinct()


def country_pairs(found: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Counts per country pair."""
    pair = [F.coalesce(F.col(x), F.lit("Unknown")).alias(x) for x in ("src_country", "dst_country")]
    per_pair = found.groupBy(*keys, *pair).agg(F.count(F.lit(1)).alias("events"))
    if limit is None:
        return per_pair
    order = [F.col("events").desc(), F.col("src_country"), F.col("dst_country")]
    if not keys:
        return per_pair.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return per_pair.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def temporal_distribution(found: DataFrame, keys: Sequence[str] = (), bucket_minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Counts per time bucket."""
    slot = F.window(c(ts).cast("timestamp"), f"{bucket_minutes} minutes")
    return found.groupBy(*keys, slot.alias("_w")).agg(F.count(F.lit(1)).alias("events")).select(
        *keys, F.col("_w.start").cast("timestamp_ntz").alias("bucket_start"),
        F.col("_w.end").cast("timestamp_ntz").alias("bucket_end"), "events")


def temporal_metrics(buckets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bucket counts, mean, population variance and beacon strength."""
    stats = buckets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bucket_count"), F.count_if(F.col("events") > 0).alias("active_buckets"),
        F.avg("events").alias("avg_per_bucket"), F.var_pop("events").alias("variance"))
    avg, variance = F.col("avg_per_bucket"), F.col("variance")
    strength = F.when((variance < avg * 0.3) & (avg > 1), "strong").when(
        (variance < avg * 0.7) & (avg > 0.5), "moderate").otherwise("none")
    return stats.withColumn("beaconing_indicator", strength)


def _value_counts(found: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return found.filter(F.length(column) > 0).groupBy(*keys, F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("events")).withColumn("metric", F.lit(column))


def protocol_details(found: DataFrame, keys: Sequence[str], log_type: str, distinct: Sequence[str],
                     counted: Sequence[str]) -> DataFrame:
    """Long rows (metric, value, events): distinct counts and value counts of one log type."""
    rows = found.filter(F.col("log_type") == log_type)
    uniques = rows.groupBy(*keys).agg(*[F.countDistinct(x).alias(x) for x in distinct])
    pairs = F.array(*[F.struct(F.lit(f"unique_{x}").alias("metric"), F.col(x).alias("events")) for x in distinct])
    out = uniques.withColumn("_p", F.explode(pairs)).select(
        *keys, F.col("_p.metric").alias("metric"), F.lit(None).cast("string").alias("value"), F.col("_p.events").alias("events"))
    for column in counted:
        out = out.unionByName(_value_counts(rows, keys, column).select(*keys, "metric", "value", "events"))
    return out


def dns_details(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return protocol_details(found, keys, "dns", ["query"], ["qtype_name", "rcode_name"])


def http_details(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return protocol_details(found, keys, "http", ["user_agent"], ["method", "status_code"])


def tls_details(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return protocol_details(found, keys, "ssl", ["ja3", "server_name"], ["version"])


def smtp_details(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return protocol_details(found, keys, "smtp", ["mailfrom", "rcptto"], [])


def peer_counts(found: DataFrame, keys: Sequence[str], distinct_sides: bool = False) -> DataFrame:
    """Events per address on either side; with ``distinct_sides`` each address counts once per side."""
    if distinct_sides:
        rows = distinct_addresses(found, keys)
    else:
        rows = found.select(*keys, F.explode(F.array("src_ip", "dst_ip")).alias("ip")).filter(F.length("ip") > 0)
    return rows.groupBy(*keys, "ip").agg(F.count(F.lit(1)).alias("events"))


def top_peers(peers: DataFrame, keys: Sequence[str], limit: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("events").desc(), "ip"))
    return peers.withColumn("position", rank).filter(F.col("position") <= limit)


def peer_concentration(peers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of the one and three busiest peers and the concentration level."""
    totals = peers.groupBy(*keys).agg(F.sum("events").alias("total"))
    best = top_peers(peers, keys, 3).groupBy(*keys).agg(
        F.max("events").alias("_top1"), F.sum("events").alias("_top3"))
    if keys:
        joined = totals.join(best, list(keys))
    else:
        joined = best.withColumn("total", totals.scalar())
    top1 = ratio(F.col("_top1"), F.col("total"))
    level = F.when(top1 > 0.7, "high").when(top1 > 0.5, "medium").otherwise("low")
    return joined.select(*keys, "total", top1.alias("top1_share"), ratio(F.col("_top3"), F.col("total")).alias("top3_share"),
                         level.alias("concentration_level"))


def window_assets(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct addresses in a window, with and without the trigger."""
    rows = distinct_addresses(found, keys)
    return rows.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("side") == "src", F.col("ip"))).alias("distinct_src_ip_count"),
        F.countDistinct(F.when(F.col("side") == "dst", F.col("ip"))).alias("distinct_dst_ip_count"),
        F.countDistinct("ip").alias("distinct_ip_total"),
    ).withColumn("distinct_ip_excluding_trigger", F.greatest(F.lit(0).cast("long"), F.col("distinct_ip_total") - 1))


def field_review(logs: Mapping[str, DataFrame], found: DataFrame) -> DataFrame:
    """Columns present and match fields used per log table."""
    spark = found.sparkSession
    present = [(log_type, name, "present") for log_type, df in logs.items() for name in df.columns]
    rows = spark.createDataFrame(present, "log_type string, field string, use string")
    used = found.select("log_type", F.col("matched_field").alias("field"), F.lit("used").alias("use")).distinct()
    return rows.unionByName(used)
