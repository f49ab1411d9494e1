"""Joins that add session, alert, geographic, asset and reputation facts to events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import ipv4_number, is_ipv4, is_private
from ..functions.columns import c

ANY_PORT = -1


def match_sessions(events: DataFrame, sessions: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Events with the uid, service and state of the first session that fits.

    A session fits when both addresses agree, each port agrees if the event has it, and the times
    differ by at most ``tolerance`` seconds. The first one in order of (ts, uid) wins, which is the
    earliest session at or after ``t - tolerance``. That makes it an as-of search instead of an
    interval join: the distinct search times and the sessions of a key are merged in time order,
    and a running value carries the next session back to the search. Keys are cut into time
    slices, with the first session of the following slice as a sentinel, so neither a busy pair nor
    a long log is ordered in one task, and no event-session pairs are formed.
    """
    width = 2 * tolerance
    key = ["si", "di", "_sp", "_dp"]

    def port(col: Column) -> Column:
        return F.coalesce(col, F.lit(ANY_PORT))

    keyed = events.withColumns({"_sp": port(F.col("sp")), "_dp": port(F.col("dp"))})
    searches = keyed.filter(F.col("si").isNotNull() & F.col("di").isNotNull()).select(*key, "t").distinct()

    # An event without a port accepts any, so a session is offered under every mask of its ports.
    masks = F.array(*[
        F.struct((F.col("orig_p") if a else F.lit(ANY_PORT)).alias("_sp"), (F.col("resp_p") if b else F.lit(ANY_PORT)).alias("_dp"))
        for a in (True, False) for b in (True, False)
    ])
    offered = sessions.select(
        F.col("orig_h").alias("si"), F.col("resp_h").alias("di"), "ts", F.explode(masks).alias("_m"),
        F.struct("uid", "service", "conn_state").alias("_session"),
    ).select("si", "di", "_m.*", "ts", "_session")
    first_at = offered.groupBy(*key, "ts").agg(F.min("_session").alias("_session"))
    first_at = first_at.withColumn("_slice", F.floor(F.col("ts") / width))
    entry = F.struct(F.col("ts").alias("ts"), F.col("_session").alias("session"))
    sentinels = first_at.groupBy(*key, "_slice").agg(F.min(entry).alias("_entry")).withColumn("_slice", F.col("_slice") - 1)

    start = F.col("t") - tolerance
    no_entry = F.lit(None).cast(sentinels.schema["_entry"].dataType)
    merged = (
        searches.select(*key, F.floor(start / width).alias("_slice"), start.alias("_at"), F.col("t"), no_entry.alias("_entry"))
        .unionByName(first_at.select(*key, "_slice", F.col("ts").alias("_at"), F.lit(None).cast("double").alias("t"), entry.alias("_entry")))
        .unionByName(sentinels.select(*key, "_slice", F.col("_entry.ts").alias("_at"), F.lit(None).cast("double").alias("t"), "_entry"))
    )
    # Descending, sessions before searches at the same time: the last entry seen is the next one in time.
    backwards = Window.partitionBy(*key, "_slice").orderBy(F.col("_at").desc(), F.col("t").isNull().desc())
    carried = F.last("_entry", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = merged.withColumn("_next", carried).filter(F.col("t").isNotNull())
    hits = hits.filter(F.abs(F.col("_next.ts") - F.col("t")) <= tolerance).select(
        *key, "t", F.col("_next.session.uid").alias("zeek_uid"), F.col("_next.session.service").alias("zeek_service"),
        F.col("_next.session.conn_state").alias("zeek_conn_state"))
    fresh = [x for x in keyed.columns if x not in ("zeek_uid", "zeek_service", "zeek_conn_state")]
    return keyed.select(fresh).join(hits, [*key, "t"], "left").drop("_sp", "_dp")


def match_alerts(alerts: DataFrame, events: DataFrame, order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Each alert with the first event of one of its end points.

    The source or the destination must agree, and the port of that side unless one of the two has
    none. Events are reduced to their first row per (side, address, port), per (side, address) and
    per (side, address) without a port; an alert then looks up at most two of those rows per side.
    So a busy address contributes three rows and the OR needs no nested loop.
    """
    first = F.min(F.struct(*order))
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("si").alias("ip"), F.col("sp").alias("port")),
        F.struct(F.lit("dst").alias("side"), F.col("di").alias("ip"), F.col("dp").alias("port")),
    )
    ends = events.select(*order, F.explode(sides).alias("e")).select(*order, "e.*").filter(F.col("ip").isNotNull())
    per_port = ends.groupBy("side", "ip", "port").agg(first.alias("first"))
    exact = per_port.select("side", "ip", F.coalesce(F.col("port").cast("string"), F.lit("none")).alias("slot"), "first")
    anything = per_port.groupBy("side", "ip").agg(F.min("first").alias("first")).select("side", "ip", F.lit("any").alias("slot"), "first")
    lookup = exact.unionByName(anything)

    def slots(port: str) -> Column:
        return F.when(F.col(port).isNull(), F.array(F.lit("any"))).otherwise(F.array(F.col(port).cast("string"), F.lit("none")))

    wanted = F.concat(
        F.transform(slots("src_port"), lambda s: F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip"), s.alias("slot"))),
        F.transform(slots("dst_port"), lambda s: F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip"), s.alias("slot"))),
    )
    asked = alerts.select("alert_key", F.explode(wanted).alias("w")).select("alert_key", "w.*")
    matched = asked.join(lookup, ["side", "ip", "slot"]).groupBy("alert_key").agg(F.min("first").alias("first"))
    return alerts.join(matched.select("alert_key", "first.*"), "alert_key", "left")


def attach_alerts(events: DataFrame, matched: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events with the alert fields of their first matched alert and the number of alerts."""
    first = F.min(F.struct("alert_key", "sid", "message", "priority", "classification"))
    per_event = matched.filter(c(event_id).isNotNull()).groupBy(event_id).agg(
        first.alias("_a"), F.count(F.lit(1)).alias("alert_count"))
    per_event = per_event.select(
        event_id, F.col("_a.sid").alias("alert_sid"), F.col("_a.message").alias("alert_msg"),
        F.col("_a.priority").alias("alert_priority"), F.col("_a.classification").alias("alert_class"), "alert_count")
    rest = [x for x in events.columns if x not in ("alert_sid", "alert_msg", "alert_priority", "alert_class")]
    return events.select(rest).join(per_event, event_id, "left").fillna(0, ["alert_count"])


def block_pieces(blocks: DataFrame, shift: int) -> DataFrame:
    """(_net, _n, _b): from address ``_n`` on, up to the next row of its network, ``_b`` is the innermost block, or NULL.

    A sweep: starts and ends of blocks in order; the running depth says how many are open, and the innermost one is the
    last start that reached the present depth. So a network costs a sort of its blocks. That holds where blocks
    are nested or apart, as address blocks are; networks in which two blocks cross are found on the way (a block
    that ends behind the one it starts in), and only there each cut point looks through its network's blocks.
    """
    laid = blocks.filter("lo <= hi").withColumn("_net", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    # Of blocks over the same range the greatest country counts.
    laid = laid.groupBy("_net", "lo", "hi").agg(F.max(F.struct("country_code", "country_name")).alias("_c"))
    first, last = F.shiftleft("_net", shift), F.shiftleft(F.col("_net") + 1, shift) - 1
    own = F.struct("lo", "hi", "_c.country_code", "_c.country_name")
    edges = F.array(
        F.struct(F.greatest("lo", first).alias("at"), F.lit(1).alias("step"), own.alias("b")),
        F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("step"), own.alias("b")))
    events = laid.select("_net", F.explode(edges).alias("e")).select("_net", "e.at", "e.step", "e.b").filter(F.col("at") <= last)
    # At one address ends come before starts, and outer starts before inner ones.
    order = ["at", "step", F.col("b.lo"), F.col("b.hi").desc()]
    swept = Window.partitionBy("_net").orderBy(*order)
    events = events.withColumns({
        "_i": F.row_number().over(swept), "_depth": F.sum("step").over(swept.rowsBetween(Window.unboundedPreceding, 0)),
        "_last_here": F.coalesce(F.lead("at").over(swept) != F.col("at"), F.lit(True))})
    start = F.when(F.col("step") == 1, F.col("b"))
    same_depth = Window.partitionBy("_net", "_depth").orderBy("_i")
    covered = events.withColumn("_b", F.last(start, ignorenulls=True).over(same_depth.rowsBetween(Window.unboundedPreceding, 0)))
    covered = covered.withColumn("_b", F.when(F.col("_depth") > 0, F.col("_b")))
    # What covers the place right before a start must reach as far as the block that starts there.
    outer = F.lag("_b").over(Window.partitionBy("_net").orderBy("_i"))
    checked = covered.withColumn("_outer", outer)
    crossing = checked.filter((F.col("step") == 1) & (F.col("_outer.hi") < F.col("b.hi"))).select("_net").distinct()
    crossing = crossing.withColumn("_crosses", F.lit(True))
    nested = covered.filter("_last_here").join(crossing, "_net", "left_anti").select("_net", F.col("at").alias("_n"), "_b")

    entry = F.struct("lo", (-F.col("hi")).alias("minus_hi"), "_c.country_code", "_c.country_name")
    crossed = laid.join(crossing, "_net", "left_semi").groupBy("_net").agg(F.collect_set(entry).alias("_blocks"))
    cuts = F.concat(F.transform("_blocks", lambda b: F.greatest(b["lo"], first)), F.transform("_blocks", lambda b: 1 - b["minus_hi"]))
    points = crossed.select("_net", "_blocks", F.explode(F.array_distinct(cuts)).alias("_n")).filter(F.col("_n") <= last)
    inner = F.array_max(F.filter("_blocks", lambda b: (b["lo"] <= F.col("_n")) & (-b["minus_hi"] >= F.col("_n"))))
    found = points.select("_net", "_n", inner.alias("_x"))
    rest = found.select("_net", "_n", F.when(F.col("_x").isNotNull(), F.struct(
        F.col("_x.lo").alias("lo"), (-F.col("_x.minus_hi")).alias("hi"), F.col("_x.country_code").alias("country_code"), F.col("_x.country_name").alias("country_name"))).alias("_b"))
    return nested.unionByName(rest)


def geo_of_addresses(addresses: DataFrame, blocks: DataFrame, ip: str = "ip", bits: int = 16) -> DataFrame:
    """Country of each distinct address.

    ``blocks`` has ranges ``lo``..``hi`` with ``country_code`` and ``country_name``; they may be nested, and the
    innermost one counts. Blocks are laid over the networks of ``bits`` prefix bits and cut there into disjoint pieces
    by a sweep (``block_pieces``). Inside a network, addresses and starts of pieces are merged in order and the last
    start is carried forward, so the work is a sort and not a range join.
    """
    shift = 32 - bits
    known = addresses.select(c(ip).alias("ip")).filter(F.col("ip").isNotNull()).distinct()
    private = is_private(F.col("ip"))
    valid = is_ipv4(F.col("ip")) | F.col("ip").contains(":")
    classed = known.select("ip", private.alias("_private"), valid.alias("_valid"), ipv4_number(F.col("ip")).alias("_n"))
    searched = classed.filter(~F.col("_private") & F.col("_n").isNotNull())

    owned = block_pieces(blocks, shift)
    block = F.struct(F.col("_b.hi").alias("hi"), F.col("_b.country_code").alias("country_code"), F.col("_b.country_name").alias("country_name"))
    nothing = F.struct(F.lit(-1).cast("long").alias("hi"), F.lit(None).cast("string").alias("country_code"), F.lit(None).cast("string").alias("country_name"))
    starts = owned.select("_net", "_n", F.when(F.col("_b").isNotNull(), block).otherwise(nothing).alias("_block"), F.lit(None).cast("string").alias("ip"))
    no_block = F.lit(None).cast(starts.schema["_block"].dataType)
    probes = searched.select(F.shiftright("_n", shift).alias("_net"), "_n", no_block.alias("_block"), "ip")
    ordered = Window.partitionBy("_net").orderBy("_n", F.col("ip").isNotNull())
    carried = F.last("_block", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = starts.unionByName(probes).withColumn("_found", carried).filter(F.col("ip").isNotNull())
    inside = F.col("_found.hi") >= F.col("_n")
    placed = placed.select("ip", F.when(inside, F.col("_found.country_code")).alias("code"),
                           F.when(inside, F.col("_found.country_name")).alias("name"))

    def labelled(df: DataFrame, code: Column, name: Column, external: Column) -> DataFrame:
        return df.select("ip", code.alias("country_code"), name.alias("country_name"), external.alias("is_external"))

    rest = classed.filter(F.col("_private") | F.col("_n").isNull())
    return labelled(
        placed, F.coalesce("code", F.lit("XX")), F.coalesce("name", F.lit("Unknown")), F.lit(True)
    ).unionByName(labelled(
        rest, F.when(F.col("_private"), "PRIVATE").otherwise("XX"),
        F.when(F.col("_private"), "Private Network").otherwise("Unknown"), ~F.col("_private") & F.col("_valid")))


def with_geo(events: DataFrame, blocks: DataFrame, ip: str, prefix: str = "geo.") -> DataFrame:
    """Events with country code, name and an external flag of one address column."""
    places = geo_of_addresses(events, blocks, ip)
    names = {x: f"{prefix}{x}" for x in ("country_code", "country_name", "is_external")}
    joined = events.join(places.withColumnsRenamed(names).withColumnRenamed("ip", ip), ip, "left")
    return joined.withColumns({
        names["country_code"]: F.coalesce(c(names["country_code"]), F.lit("XX")),
        names["country_name"]: F.coalesce(c(names["country_name"]), F.lit("Unknown")),
        names["is_external"]: F.coalesce(c(names["is_external"]), F.lit(False)),
    })


def with_assets(events: DataFrame, assets: DataFrame, ip: str) -> DataFrame:
    """Asset facts of one address column (J7); Spark broadcasts the table while it is small."""
    facts = assets.select(c("ip_address").alias(ip), "asset_type", "importance", "owner")
    return events.join(facts, ip, "left")


def with_reputation(events: DataFrame, reputation: DataFrame, column: str) -> DataFrame:
    """Reputation score of an address or name column."""
    best = F.max(F.struct("reputation_score", "threat_type")).alias("best")
    scores = reputation.groupBy("indicator").agg(best).select("indicator", "best.threat_type", "best.reputation_score")
    return events.join(scores.withColumnRenamed("indicator", column), column, "left")
