"""Correlation of blocks into groups (C family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import computed, first_rule, time_bucket
from .blocks import BLOCKS_TYPE, PARTS, add_blocks, fact_of, filled, staged_facts

# Order of blocks in a group; others come after these by name, IDS last.
BLOCK_ORDER = ["META", "FLOW", "PROTO:IP", "PROTO:IPV6", "PROTO:TCP", "PROTO:UDP", "PROTO:ICMP"]
OTHERS, LAST = 50, 99

LEVELS = ["packet", "transaction", "flow"]
CONFIDENCES = ["high", "medium", "low"]


def parse_blocks(text: Column) -> Column:
    """Blocks of a text with ``[TYPE]`` headers and ``key=value`` lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # A header line starts a new part; lines before the first header have no type and are dropped.
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\[.*\]$"), F.concat(F.lit("\u0001"), x)).otherwise(x)), "\n")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.startswith("["))

    def one(part: Column) -> Column:
        rows = F.filter(F.split(part, "\n"), lambda x: x != "")
        facts = F.filter(F.slice(rows, 2, F.size(rows)), lambda x: x.contains("="))
        pairs = F.transform(facts, lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("key"),
            F.regexp_replace(x, "^[^=]*=", "").alias("value")))
        # Of a repeated key the last line counts.
        keys = F.transform(pairs, lambda p: p["key"])
        pairs = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
        header = F.element_at(rows, 1)
        return F.struct(F.regexp_replace(header, r"^\[|\]$", "").alias("type"), F.map_from_entries(pairs).alias("kv"))

    return F.transform(parts, one).cast(BLOCKS_TYPE)


def _fact(blocks: Column, types: Column, kind: str, *keys: str) -> Column:
    """The value of a key in the first block of a kind."""
    block = F.try_element_at(blocks, F.nullif(F.array_position(types, kind), F.lit(0)).cast("int"))
    values = [F.nullif(F.try_element_at(block["kv"], F.lit(k)), F.lit("")) for k in keys]
    return F.coalesce(*values)


CORRELATION_FACTS = {
    "ts": ("META", "ts"),
    "ts_precise": ("META", "ts_precise"),
    "frame_number": ("META", "frame_number"),
    "pcap_packet_id": ("META", "pcap_packet_id"),
    "zeek_uid": ("META", "zeek_uid"),
    "src_ip": ("FLOW", "src_ip"),
    "dst_ip": ("FLOW", "dst_ip"),
    "src_port": ("FLOW", "src_port"),
    "dst_port": ("FLOW", "dst_port"),
    "proto": ("FLOW", "proto"),
    "dns_id": ("PROTO:DNS", "id", "txid"),
    "http_stream_id": ("PROTO:HTTP", "stream_id"),
    "tls_handshake_id": ("PROTO:TLS", "handshake_id"),
    "ip_id": ("PROTO:IP", "id"),
    "tcp_seq": ("PROTO:TCP", "seq"),
}


def correlation_facts(df: DataFrame) -> DataFrame:
    """The identifying facts of each row as a struct ``meta``."""
    # Reversed, so that the last block of a kind is found first.
    backwards = F.reverse("blocks")
    staged = computed(df, "_b", F.struct(backwards.alias("blocks"), F.transform(backwards, lambda b: b["type"]).alias("types")))
    facts = [_fact(F.col("_b.blocks"), F.col("_b.types"), *spec).alias(name) for name, spec in CORRELATION_FACTS.items()]
    return computed(staged, "meta", F.struct(*facts)).drop("_b")


def correlated_batch(df: DataFrame, source: str, bucket_seconds: int = 1, with_text: bool = True) -> DataFrame:
    """Rows of a source that have any fact, with their correlation key.

    The identifying facts are read from the columns (C2). Blocks are only built with ``with_text``, and then only for
    rows that have a key.
    """
    staged, parts = staged_facts(df, PARTS[source](df))
    some = reduce(lambda a, b: a | b, [filled(p) for p in parts])
    facts = [fact_of(parts, *spec).alias(name) for name, spec in CORRELATION_FACTS.items()]
    # The condition is a flag of the generated struct: a filter over all facts would be taken apart by the optimizer.
    found = computed(staged, "_m", F.struct(some.alias("some"), F.struct(*facts).alias("meta"))).filter("_m.some")
    keyed = with_correlation(found.withColumn("meta", F.col("_m.meta")).drop("_m"), bucket_seconds)
    return add_blocks(keyed.filter(F.col("corr_key").isNotNull()), parts) if with_text else keyed.drop("_facts")


def correlation_key(meta: Column, bucket_seconds: int = 1, missing_port: str = "None") -> Column:
    """struct(key, level, confidence, method) by the first identification that is possible."""
    m = {name: meta[name] for name in CORRELATION_FACTS}
    known = {name: value.isNotNull() for name, value in m.items()}
    port = lambda name: F.coalesce(m[name], F.lit(missing_port))
    ends = F.concat(m["src_ip"], F.lit(":"), port("src_port"), F.lit("->"), m["dst_ip"], F.lit(":"), port("dst_port"))
    tuple_known = known["src_ip"] & known["dst_ip"] & known["proto"]
    with_proto = F.concat(F.lit("5tuple="), ends, F.lit("/"), m["proto"])
    seconds = F.when(m["ts"].contains("T"), F.unix_micros(F.try_to_timestamp(m["ts"])) / F.lit(1e6)).otherwise(m["ts"].try_cast("double"))
    bucket = time_bucket(seconds, bucket_seconds)

    def key(level: str, confidence: str, method: str, *parts) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.struct(text.alias("key"), F.lit(level).alias("level"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    return first_rule(meta, [
        (known["frame_number"], key("packet", "high", "packet_level", "frame.number=", m["frame_number"])),
        (known["pcap_packet_id"], key("packet", "high", "packet_level", "pcap_packet_id=", m["pcap_packet_id"])),
        (known["ts_precise"] & tuple_known & known["ip_id"] & known["tcp_seq"],
         key("packet", "medium", "packet_derived", "ts=", m["ts_precise"], ",", with_proto, ",ip_id=", m["ip_id"], ",tcp_seq=", m["tcp_seq"])),
        (known["dns_id"] & tuple_known, key("transaction", "medium", "transaction_level", "dns_id=", m["dns_id"], ",5tuple=", ends)),
        (known["http_stream_id"] & tuple_known,
         key("transaction", "medium", "transaction_level", "http_stream=", m["http_stream_id"], ",5tuple=", ends)),
        (known["tls_handshake_id"] & tuple_known,
         key("transaction", "medium", "transaction_level", "tls_handshake=", m["tls_handshake_id"], ",5tuple=", ends)),
        (known["dns_id"], key("transaction", "low", "transaction_level", "dns_id=", m["dns_id"])),
        (known["zeek_uid"], key("flow", "medium", "flow_level", "zeek_uid=", m["zeek_uid"])),
        (tuple_known & bucket.isNotNull(), key("flow", "low", "flow_level", with_proto, ",ts_bucket=", bucket.cast("string"))),
        (tuple_known, key("flow", "low", "flow_level", with_proto)),
    ])


def with_correlation(df: DataFrame, bucket_seconds: int = 1) -> DataFrame:
    """Rows with corr_key, corr_level, corr_confidence and corr_method; NULL keys are uncorrelated."""
    staged = computed(df if "meta" in df.columns else correlation_facts(df), "_c", correlation_key(F.col("meta"), bucket_seconds))
    return staged.withColumns({
        "corr_key": F.col("_c.key"), "corr_level": F.col("_c.level"), "corr_confidence": F.col("_c.confidence"),
        "corr_method": F.coalesce("_c.method", F.lit("uncorrelated")),
    }).drop("_c")


def corr_id(level: Column, key: Column) -> Column:
    """C4."""
    return F.concat(level, F.lit("_"), F.substring(F.md5(key), 1, 8))


def merge_groups(correlated: DataFrame, order: str) -> DataFrame:
    """One row per correlation key with its merged blocks.

    Per block type and fact the longest value wins, among equals the first by ``order``. That choice
    is a partial aggregate, so a key with very many rows is reduced in every map task. What is
    gathered afterwards is at most one value per fact name.

    These aggregates sort their rows by the grouping columns. A hash of these comes first, since most keys begin with the
    same characters and would be compared at full length.
    """
    keys = ["corr_key", "corr_level", "corr_confidence"]
    rows = correlated.filter(F.col("corr_key").isNotNull()).select(F.xxhash64(*keys).alias("_h"), *keys, F.col(order).alias("_ord"), "blocks")
    facts = rows.select("_h", *keys, "_ord", F.explode("blocks").alias("b"))
    facts = facts.select("_h", *keys, "_ord", F.col("b.type").alias("type"), F.explode("b.kv").alias("fact", "value"))
    best = facts.groupBy(F.xxhash64("_h", "type", "fact").alias("_f"), "_h", *keys, "type", "fact").agg(
        F.min(F.struct((-F.length("value")).alias("rank"), F.col("_ord"), F.col("value"))).alias("best"))
    position = F.array_position(F.array(*[F.lit(x) for x in BLOCK_ORDER]), F.col("type"))
    rank = F.when(F.col("type") == "PROTO:IDS", LAST).when(position > 0, position.cast("int")).otherwise(OTHERS)
    entry = F.struct(rank.alias("rank"), F.col("type"), F.col("fact"), F.col("best.value").alias("value"))
    groups = best.groupBy("_h", *keys).agg(F.array_sort(F.collect_list(entry)).alias("_e"))

    def text(kind: Column) -> Column:
        of_kind = F.filter("_e", lambda e: e["type"].eqNullSafe(kind))
        lines = F.transform(of_kind, lambda e: F.concat(e["fact"], F.lit("="), e["value"]))
        return F.array_join(F.concat(F.array(F.concat(F.lit("["), kind, F.lit("]"))), lines), "\n")

    kinds = F.array_distinct(F.transform("_e", lambda e: e["type"]))
    return groups.select(corr_id(F.col("corr_level"), F.col("corr_key")).alias("corr_id"), *keys, F.transform(kinds, text).alias("blocks"))


def correlation_counters(correlated: DataFrame) -> DataFrame:
    """Rows by method, including the uncorrelated."""
    return correlated.groupBy("corr_method").agg(F.count(F.lit(1)).alias("rows"))


def correlation_quality(groups: DataFrame) -> DataFrame:
    """Groups by level and confidence."""
    return groups.groupBy("corr_level", "corr_confidence").agg(F.count(F.lit(1)).alias("groups"))


def group_text(groups: DataFrame) -> DataFrame:
    """Groups as text: a header with the correlation fields, then the blocks."""
    header = F.concat_ws(
        "\n", F.lit("[CORR_GROUP]"),
        *[F.concat(F.lit(f"{x}="), F.col(x)) for x in ("corr_id", "corr_level", "corr_key", "corr_confidence")])
    return groups.select("corr_id", F.concat_ws("\n", header, F.array_join("blocks", "\n")).alias("text"))
