"""Aggregates of many overlapping ticket windows without meeting every sighting with every window.

All windows have one width, so a sighting lies in the windows whose trigger time is at most ``hours`` before or after it. A
count over a window is a running sum in trigger time: a sighting adds one where its first window starts to see it and takes it
back behind the last one. Distinct values count the same way once the sightings of a value are merged into runs whose
gaps are no longer than a window. The rows are two per sighting time or run and one per window, however many windows overlap.

Running sums go hour by hour: totals of whole hours are carried along per indicator, and only hours that hold a trigger time
are opened. A hot indicator is spread over its hours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

INDICATOR = ["ioc_type", "ioc_value"]
HOUR = 3_600_000_000  # microseconds


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _hour_of(micros: str) -> Column:
    return F.floor(F.col(micros) / HOUR)


def _sighting_edges(found: DataFrame, key: Sequence[str], half: int, counts: Mapping[str, Column]) -> DataFrame:
    """Where sightings of one time come into sight and where they leave it, with their signed counts."""
    seen = [F.count_if(F.coalesce(condition, F.lit(False))).alias(name) for name, condition in counts.items()]
    times = found.groupBy(*key, "_at").agg(F.count(F.lit(1)).alias("sightings"), *seen)
    edges = F.array(F.struct((F.col("_at") - half).alias("pos"), F.lit(1).alias("sign")),
                    F.struct((F.col("_at") + half + 1).alias("pos"), F.lit(-1).alias("sign")))
    rows = times.select("*", F.explode(edges).alias("_e"))
    sign = F.col("_e.sign")
    return rows.select(
        *key, F.col("_e.pos").alias("_pos"), *[(F.col(n) * sign).alias(n) for n in ("sightings", *counts)],
        F.when(sign > 0, F.col("_at")).alias("_last"), F.when(sign < 0, F.col("_at")).alias("_first"))


def _value_edges(found: DataFrame, key: Sequence[str], half: int, distinct: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Where runs of a value come into sight and leave it, one signed column per distinct count.

    Sightings of one hour are always in one run, so a value is reduced to its first and last time of an hour beforehand.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("string").alias("value")) for name, values in distinct.items() for value in values])
    opened = found.select(*key, "_at", F.explode(pairs).alias("_v")).select(*key, "_at", "_v.*").filter(F.col("value").isNotNull())
    hourly = opened.groupBy(*key, "measure", "value", _hour_of("_at").alias("_h")).agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    order = Window.partitionBy(*key, "measure", "value").orderBy("_h")
    before = F.col("_from") - F.lag("_to").over(order)
    behind = F.lead("_from").over(order) - F.col("_to")
    runs = hourly.select(*key, "measure", "_from", "_to", before.alias("_before"), behind.alias("_behind"))
    apart = lambda gap: F.col(gap).isNull() | (F.col(gap) > 2 * half)
    edges = F.array_compact(F.array(
        F.when(apart("_before"), F.struct((F.col("_from") - half).alias("pos"), F.lit(1).cast("long").alias("sign"))),
        F.when(apart("_behind"), F.struct((F.col("_to") + half + 1).alias("pos"), F.lit(-1).cast("long").alias("sign")))))
    rows = runs.select(*key, "measure", F.explode(edges).alias("_e"))
    return rows.select(
        *key, F.col("_e.pos").alias("_pos"), *[F.when(F.col("measure") == n, F.col("_e.sign")).alias(n) for n in distinct])


def near_windows(found: DataFrame, windows: DataFrame, hours: int = 24) -> DataFrame:
    """Sightings on the days that some window of their indicator touches; all that lie in a window are among them."""
    half = F.make_dt_interval(hours=F.lit(hours))
    days = F.sequence(F.to_date(F.col("t0") - half), F.to_date(F.col("t0") + half), F.make_dt_interval(days=F.lit(1)))
    touched = windows.select(*INDICATOR, "t0").dropna().select(*INDICATOR, F.explode(days).alias("_day")).distinct()
    return found.withColumn("_day", F.to_date("ts")).join(touched, [*INDICATOR, "_day"], "left_semi").select(found.columns)


def window_totals(
    found: DataFrame, windows: DataFrame, hours: int = 24, by: Sequence[str] = (),
    counts: Mapping[str, Column] | None = None, distinct: Mapping[str, Sequence[Column]] | None = None,
) -> DataFrame:
    """One row per indicator, trigger time ``t0`` and value of ``by`` with sightings at most ``hours`` (at least one) away from it.

    ``found`` are sightings (ioc_type, ioc_value, ts and what the arguments name), ``windows`` has ioc_type, ioc_value and t0;
    ``by`` columns hold no NULL. The columns are sightings, one count per condition of ``counts``, one distinct count per entry of
    ``distinct`` (values of all its columns together, without NULL), first_seen and last_seen. ``found`` is read more than once:
    cut it with ``near_windows`` and write it first.
    """
    if hours < 1:
        raise ValueError("windows reach at least one hour to each side")
    counts, distinct = dict(counts or {}), dict(distinct or {})
    key, half = [*INDICATOR, *by], hours * HOUR
    measures = ["sightings", *counts, *distinct]
    asked = windows.select(*INDICATOR, "t0").dropna().distinct()
    timed = found.withColumn("_at", _micros("ts")).filter(F.col("_at").isNotNull())

    points = _sighting_edges(timed, key, half, counts)
    if distinct:
        points = points.unionByName(_value_edges(timed, key, half, distinct), allowMissingColumns=True)
    questions = asked.join(timed.select(key).distinct(), INDICATOR) if by else asked
    questions = questions.select(*key, _micros("t0").alias("_pos"), "t0")
    points = points.unionByName(questions, allowMissingColumns=True).withColumn("_hour", _hour_of("_pos"))
    points = cut_lineage(points, "window-edges")

    question = F.col("t0").isNotNull()
    hourly = points.groupBy(*key, "_hour").agg(
        *[F.sum(n).alias(n) for n in measures], F.max("_last").alias("_last"), F.min("_first").alias("_first"), F.bool_or(question).alias("_opened"))
    earlier = Window.partitionBy(*key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = hourly.select(
        *key, "_hour", "_opened", *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in measures],
        F.max("_last").over(earlier).alias("_c_last"), F.min("_first").over(later).alias("_c_first")).filter("_opened").drop("_opened")

    # At one place sightings come and go before a window is asked for.
    inside = points.join(carried, [*key, "_hour"])
    upto = Window.partitionBy(*key, "_hour").orderBy("_pos", question).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy(*key, "_hour").orderBy(F.col("_pos").desc(), question.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(0).cast("long")
    ts_type = found.schema["ts"].dataType
    time_of = lambda col: F.timestamp_micros(col).cast(ts_type)
    answers = inside.select(
        *key, "t0", *[(F.coalesce(f"_c_{n}", none) + F.coalesce(F.sum(n).over(upto), none)).alias(n) for n in measures],
        time_of(F.least("_c_first", F.min("_first").over(behind))).alias("first_seen"),
        time_of(F.greatest("_c_last", F.max("_last").over(upto))).alias("last_seen"))
    return answers.filter(question & (F.col("sightings") > 0))


def ticket_aggregate(found: DataFrame, tickets: DataFrame, hours: int = 24) -> DataFrame:
    """Sightings, distinct addresses and first / last time per ticket, table and field (A5); a ticket id stands for one ticket."""
    by = ["log_type", "matched_field"]
    totals = window_totals(found, tickets, hours, by, distinct={"distinct_src": [F.col("src_ip")], "distinct_dst": [F.col("dst_ip")]})
    return tickets.select("ticket_id", *INDICATOR, "t0").join(totals, [*INDICATOR, "t0"]).select(
        "ticket_id", *by, "sightings", "distinct_src", "distinct_dst", "first_seen", "last_seen")


def ticket_assets(found: DataFrame, tickets: DataFrame, hours: int = 24) -> DataFrame:
    """Distinct addresses in each ticket's window, with and without the trigger."""
    src, dst = (F.when(F.length(x) > 0, F.col(x)) for x in ("src_ip", "dst_ip"))
    totals = window_totals(found, tickets, hours, distinct={
        "distinct_src_ip_count": [src], "distinct_dst_ip_count": [dst], "distinct_ip_total": [src, dst]}).filter("distinct_ip_total > 0")
    return tickets.select("ticket_id", *INDICATOR, "t0").join(totals, [*INDICATOR, "t0"]).select(
        "ticket_id", "distinct_src_ip_count", "distinct_dst_ip_count", "distinct_ip_total",
        F.greatest(F.lit(0).cast("long"), F.col("distinct_ip_total") - 1).alias("distinct_ip_excluding_trigger"))
