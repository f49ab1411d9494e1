"""Shards that all hold the same mixture of sources: proportional stratified interleaving.

The rows of a source are ranked in a seeded shuffle (the order of an MD5 of seed, id and text). Rank ``k`` of ``n``
becomes the fraction ``(k + phase) / n``, with a seeded phase per source, so that sources of one row don't meet in
the middle. All rows in the order of their fractions are cut into runs whose counts differ by one at most (law
``rows``). A run of any length holds each source in proportion, give or take a row or so.

Neither rank nor cut sorts a source or the table in one task: rows are counted per digest slice (65 536 a source) or
fraction slice (16 384), the counts are summed up in order, and rows are numbered within their slice. The windows
over a whole source or table see slices, never rows. Copies of a row (same id, source and text) travel as one row
with a count until they get their ranks, so a table full of them makes no hot slice.

Groups of equal texts aren't kept in one shard: with counts at most one apart, a group larger than a shard can't be.

Defined results: a null text has no bytes (size 16, CRC 0) and ranks as an empty one; a null source is a source of its
own, apart from the empty name; rows without id and repeated rows all get places of their own; a table with fewer
rows than shards leaves shards empty; an empty table gives an empty one. Equal fractions go by source, then rank; copies of a
row are interchangeable. Long texts are only hashed and measured. Columns other than the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Hex digits of a digest slice, and the number of fraction slices.
DIGITS, FRACTIONS = 4, 1 << 14
#: What a row needs besides its text.
OVERHEAD = 16


def _row_key(seed: int, doc_id: Column, text: Column) -> Column:
    """The place of a row in the shuffle of its source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _phase(seed: int, source_key: Column) -> Column:
    """A seeded number from 0 up to 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), source_key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _running(counts: DataFrame, slice_col: str, *group: str) -> DataFrame:
    """``before``: rows in earlier slices; ``total``: rows of the group."""
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    ordered = whole.orderBy(slice_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select("*", (F.sum("rows").over(ordered) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("total")).drop("rows")


def ranked_rows(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, row_key, source_key, rank in its source, and the fraction, for every row."""
    doc_id, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        doc_id.alias("doc_id"), _source_key(docs[source_col]).alias("source_key"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), _row_key(seed, doc_id, text).alias("row_key"))
    copies = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("slice", F.substring("row_key", 1, DIGITS))
    copies = cut_lineage(copies, "shard-rows")
    places = _running(copies.groupBy("source_key", "slice").agg(F.sum("copies").alias("rows")), "slice", "source_key")
    earlier = W.partitionBy("source_key", "slice").orderBy("row_key", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("copies").over(earlier), F.lit(0))
    spread = copies.join(places, ["source_key", "slice"]).withColumn("first", first).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    rank = F.col("first") + F.col("copy")
    fraction = (rank.cast("double") + _phase(seed, F.col("source_key"))) / F.col("total").cast("double")
    return spread.select("doc_id", "size", "text_crc32", "row_key", "source_key", rank.alias("rank"), fraction.alias("fraction"))


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of :func:`ranked_rows` with their shard and their slot in it, gapless from 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = ranked_rows(docs, seed, id_col, text_col, source_col)
    rows = rows.withColumn("part", F.least(F.floor(F.col("fraction") * FRACTIONS), F.lit(FRACTIONS - 1)))
    rows = cut_lineage(rows, "shard-ranks")
    places = _running(rows.groupBy("part").agg(F.count("*").alias("rows")), "part")
    within = F.row_number().over(W.partitionBy("part").orderBy("fraction", "source_key", "rank"))
    placed = rows.join(places, "part").withColumn("position", F.col("before") + within - 1)
    shard = F.expr(f"(position * {shards}) div total")
    slot = F.expr(f"position - (shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", slot).drop("part", "before", "total", "position")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """Write (shard, slot, doc_id, source, text) as one folder a shard, its files in the order of slots."""
    places = assign_shards(docs, shards, seed, id_col, text_col, source_col).select("row_key", "source_key", "shard", "slot")
    doc_id, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    texts = docs.select(
        _row_key(seed, doc_id, text).alias("row_key"), _source_key(docs[source_col]).alias("source_key"), doc_id.alias("doc_id"),
        docs[source_col].alias("source"), docs[text_col].alias("text"))
    joined = places.join(texts.dropDuplicates(["row_key", "source_key"]), ["row_key", "source_key"])
    ordered = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("shard", "slot", "doc_id", "source", "text").write.mode("overwrite").partitionBy("shard").parquet(path)


def digest(assigned: DataFrame) -> DataFrame:
    """The columns of the query; a law of counts has no place for one more shard."""
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB, with one sort instead of slices; CRC-32 is worked out byte by byte.
SHARDS_SQL = """
    with crc as materialized (
        select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end, b)) as tab),
    raw as materialized (
        select doc_id, coalesce('=' || source, '') as src, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
    keyed as (
        select doc_id, src, octet_length(encode(text)) + 16 as size, md5('0:' || coalesce(doc_id::varchar, '') || ':' || md5(text)) as row_key,
            case when h = '' then 0 else xor(4294967295, list_reduce(
                list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, (i + 1)::bigint, 2))::bigint),
                lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) end as text_crc32
        from raw, crc),
    ranked as (
        select *, row_number() over (partition by src order by row_key, doc_id, size, text_crc32) - 1 as k, count(*) over (partition by src) as n from keyed),
    fractions as (
        select *, (k::double + ('0x' || substr(md5('0:' || src), 1, 8))::bigint::double / 4294967296.0) / n::double as f from ranked),
    placed as (
        select *, row_number() over (order by f, src, k) - 1 as p, count(*) over () as total from fractions)
    select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, ((p * 40) // total)::integer as shard,
        (p - ((p * 40) // total * total + 39) // 40)::bigint as slot, null::integer as grown_shard
    from placed"""
