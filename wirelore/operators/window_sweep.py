"""All aggregates of overlapping ticket windows from one sweep over trigger time (K9).

All windows have one width, so a sighting is in sight of trigger times at most ``hours`` before or after it. Per indicator and span
of trigger times (two windows long), sightings come into sight and leave it in order, and running counts are read off wherever a
window is asked for. Every sighting is given to the one or two spans it is in sight of and in which its indicator has a window, so the
rows grow with sightings and windows and not with their pairs; a hot indicator is spread over its spans. What a task holds are the
counts and times in sight of one indicator.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.layers import table_protocol
from .window_index import HOUR, INDICATOR, _micros

SPAN = 4  # half windows
DISTINCT = {
    "src_ip": "distinct_src_ip_count", "dst_ip": "distinct_dst_ip_count", "query": "unique_queries", "user_agent": "unique_user_agents",
    "ja3": "unique_ja3", "mailfrom": "unique_senders", "rcptto": "unique_recipients",
}
LOG_TYPES = ("dns", "http", "ssl", "smtp", "ssh", "rdp", "telnet")
FLAGS = ("txt_queries", "null_queries", "nxdomain", "post_requests", "get_requests")
ANSWER = ("ioc_type string, ioc_value string, _pos long, total_sightings long, _first long, _last long, _kinds array<struct<log_type:string,matched_field:string>>, "
          + ", ".join(f"{n} long" for n in (*[f"{t}_sightings" for t in LOG_TYPES], *FLAGS, *DISTINCT.values()))
          + ", _top1 long, _top3 long, _peers long, bucket_count long, _squares long")


class Sight:
    """Running counts of the sightings in sight; they leave in the order in which they came."""

    def __init__(self) -> None:
        self.times: deque[int] = deque()
        self.kinds: dict[tuple, int] = {}  # (log type, field, flags)
        self.values: list[dict[str, int]] = [{} for _ in DISTINCT]
        self.hours: dict[int, int] = {}
        self.squares = 0  # of the counts of hours
        self.peers: dict[str, int] = {}
        self.total = 0  # of the counts of peers
        self.holders: dict[int, int] = {}  # count -> peers with it
        self.levels: list[int] = []  # counts that some peer has, in order

    @staticmethod
    def _count(counts: dict, value, sign: int) -> int:
        now = counts.get(value, 0) + sign
        if now:
            counts[value] = now
        else:
            del counts[value]
        return now

    def _peer(self, address: str, sign: int) -> None:
        now = self._count(self.peers, address, sign)
        self.total += sign
        if now - sign and not self._count(self.holders, now - sign, -1):
            del self.levels[bisect_left(self.levels, now - sign)]
        if now and self._count(self.holders, now, 1) == 1:
            insort(self.levels, now)

    def change(self, sign: int, at: int, kind: tuple, values: tuple) -> None:
        if sign > 0:
            self.times.append(at)
        else:
            self.times.popleft()
        self._count(self.kinds, kind, sign)
        for counts, value in zip(self.values, values, strict=True):
            if value is not None:
                now = counts.get(value, 0) + sign
                if now:
                    counts[value] = now
                else:
                    del counts[value]
        for address in values[:2]:  # source and destination
            if address:
                self._peer(address, sign)
        now = self._count(self.hours, at // HOUR, sign)
        self.squares += now * now - (now - sign) * (now - sign)

    def answer(self) -> tuple:
        best: list[int] = []
        for level in reversed(self.levels):
            best += [level] * min(self.holders[level], 3 - len(best))
            if len(best) == 3:
                break
        logs, flags = Counter(), [0] * len(FLAGS)
        for (log, _field, bits), n in self.kinds.items():
            logs[log] += n
            flags = [f + n * (bits >> i & 1) for i, f in enumerate(flags)]
        kinds = sorted({(log, field) for log, field, _bits in self.kinds})
        return (
            len(self.times), self.times[0], self.times[-1], [{"log_type": a, "matched_field": b} for a, b in kinds], *[logs[t] for t in LOG_TYPES], *flags,
            *[len(v) for v in self.values], best[0] if best else None, sum(best) if best else None, self.total, len(self.hours), self.squares)


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers of the windows in rows that are sorted by indicator, span and place."""
    names = [x.split()[0] for x in ANSWER.replace("array<struct<log_type:string,matched_field:string>>", "a").split(", ")]
    current, sight = None, Sight()
    for batch in batches:
        out = []
        columns = [batch[c].tolist() for c in (*INDICATOR, "_span", "_pos", "_sign", "_at", "log_type", "matched_field", "_flags", *DISTINCT)]
        for kind, value, span, pos, sign, at, log, field, flags, *values in zip(*columns, strict=True):
            if current != (kind, value, span):
                current, sight = (kind, value, span), Sight()
            if sign:
                sight.change(sign, at, (log, field, flags), values)
            elif sight.times:
                out.append((kind, value, pos, *sight.answer()))
        if out:
            yield pd.DataFrame(out, columns=names)


def window_features(found: DataFrame, windows: DataFrame, hours: int = 24) -> DataFrame:
    """The columns of ``ticket_reports.window_features`` per ioc_type, ioc_value and trigger time ``t0`` of ``windows`` with sightings."""
    half = hours * HOUR
    length = SPAN * half
    seen = [F.col("qtype_name") == "TXT", F.col("qtype_name") == "NULL", F.col("rcode_name").isin("NXDOMAIN", "3"), F.col("method") == "POST", F.col("method") == "GET"]
    flags = sum((F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(seen)), F.lit(0))
    span_of = lambda micros: F.floor(micros / length)
    asked = windows.select(*INDICATOR, _micros("t0").alias("_pos")).dropna().distinct().withColumn("_span", span_of(F.col("_pos")))
    timed = found.select(*INDICATOR, _micros("ts").alias("_at"), "log_type", "matched_field", flags.alias("_flags"), *DISTINCT).filter(F.col("_at").isNotNull())
    spans = F.sequence(span_of(F.col("_at") - half), span_of(F.col("_at") + half))
    placed = timed.withColumn("_span", F.explode(spans)).join(asked.select(*INDICATOR, "_span").distinct(), [*INDICATOR, "_span"])
    start, leaves = F.col("_span") * length, F.col("_at") + half + 1
    edges = F.array_compact(F.array(
        F.struct(F.greatest(F.col("_at") - half, start).alias("pos"), F.lit(1).alias("sign")),
        F.when(leaves < start + length, F.struct(leaves.alias("pos"), F.lit(-1).alias("sign")))))
    rows = placed.withColumn("_e", F.explode(edges)).select("*", F.col("_e.pos").alias("_pos"), F.col("_e.sign").alias("_sign")).drop("_e")
    # At one place sightings come and go before a window is asked for.
    rows = rows.unionByName(asked.withColumns({"_sign": F.lit(0), "_at": F.lit(0).cast("long"), "_flags": F.lit(0)}), allowMissingColumns=True)
    group = [*INDICATOR, "_span"]
    answers = rows.repartition(*group).sortWithinPartitions(*group, "_pos", F.col("_sign") == 0, "_at").mapInPandas(_swept, ANSWER)

    k, n = F.col("bucket_count"), F.col("total_sightings")
    avg, variance = F.col("bucket_avg"), F.col("bucket_variance")
    # Written out as squares of whole numbers, so that nothing is lost before the one division.
    spread = (k.cast("decimal(38,0)") * F.col("_squares").cast("decimal(19,0)") - n.cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast("double")
    strength = F.when((variance < avg * 0.3) & (avg > 1), "strong").when((variance < avg * 0.7) & (avg > 0.5), "moderate").otherwise("none")
    top1 = ratio(F.col("_top1"), F.col("_peers"))
    level = F.when(top1 > 0.7, "high").when(top1 > 0.5, "medium").otherwise("low")
    logs = F.array_distinct(F.col("_kinds.log_type"))
    out = answers.withColumns({
        "t0": F.timestamp_micros("_pos").cast(windows.schema["t0"].dataType),
        "first_seen": F.timestamp_micros("_first").cast(found.schema["ts"].dataType), "last_seen": F.timestamp_micros("_last").cast(found.schema["ts"].dataType),
        "protocols": F.size(logs).cast("long"), "coverage": F.size("_kinds").cast("long"),
        "protocols_involved": F.array_sort(F.array_distinct(F.transform(logs, table_protocol))),
        "matched_fields": F.array_sort(F.array_distinct(F.col("_kinds.matched_field"))),
        "has_dns_details": F.col("dns_sightings") > 0, "has_http_details": F.col("http_sightings") > 0, "has_tls_details": F.col("ssl_sightings") > 0,
        "top1_share": top1, "top3_share": ratio(F.col("_top3"), F.col("_peers")), "concentration_level": F.when(F.col("_peers") > 0, level),
        "bucket_avg": n / k, "bucket_variance": spread / k / k})
    return out.withColumn("beaconing_indicator", strength).drop("_pos", "_first", "_last", "_kinds", "_top1", "_top3", "_peers", "_squares")
