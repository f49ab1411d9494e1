"""Near duplicates from bottom-k sketches of one hash function.

1. Every document becomes the set of its 5-word shingles (64-bit hashes). Its sketch is the k smallest of them. Documents
   with equal sets are one class from here on; the smallest id stands for it.
2. Retained values are counted in a table of fixed size. Two sets with a Jaccard similarity of 0.75 share at least
   ``_shared`` retained values (exactly so for sets that fit the sketch, else with a chance of error near one in a
   million), so among each sketch's rarest values - all but ``_shared`` - 1 of them - they share one. Only these
   values enter the inverted lists, which keeps passages that many documents quote out of the lists.
3. A list is not expanded into pairs. Its most ordinary member (the one whose values are most frequent) leads it, and
   every member is compared with its leader: the union sketch estimates the similarity, full sets verify it. Members that
   are linked to the leader need no comparison with each other.
4. Members that are not linked to their leader are compared with the other members of its lists, in blocks of about
   ``CHUNK`` x ``CHUNK``: sketches first, then full sets of what is left. A block returns a spanning set of its links.
5. Components of all links, by alternating star steps.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a text with fewer than five
words has its word sequence as its only shingle. Rows that repeat an id are linked by their own texts. A null id takes no part in links: component_id is null and kept is true. An empty table gives an empty
table. Other columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .tables import free_finished, id_and_text

WORDS = 5
K = 64
MIN_SHARED = 30  # of 64 values of a union sketch, 48 +- 3.5 are shared at similarity 0.75
BUCKET_BITS = 21
CHUNK = 512
_PIECE = 1_000_000  # characters hashed at once
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes know no other letters)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _PIECE):
            size += len(texts[to])
            to += 1
        words = [words_of(t) for t in texts[at:to]]
        flat = np.array([w for ws in words for w in ws] + [b""], dtype=object)
        h = pd.util.hash_array(flat, categorize=False)
        n = len(h) - 1
        rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for i in range(WORDS):
            rolled += h[i:i + len(rolled)] * _ODD[i]
        rolled = _mix(rolled)
        start = 0
        for ws in words:
            if len(ws) >= WORDS:
                yield np.unique(rolled[start:start + len(ws) - WORDS + 1])
            elif ws:
                own = np.append(h[start:start + len(ws)] * _ODD[: len(ws)], np.array([len(ws)], np.uint64) * _ODD[4:]).sum(dtype=np.uint64)
                yield _mix(np.array([own], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            start += len(ws)
        at = to


def fingerprint(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums over differently mixed values: equal for equal sets, and for others with a chance of 2^-128."""
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(_mix(s ^ _ODD[1]).sum(dtype=np.uint64).view(np.int64))


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _shared(n: int) -> int:
    """Least number of retained values that a set of n shingles shares with any set it is linked to."""
    return max(1, min(MIN_SHARED, math.ceil(0.75 * n)))


def _linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= 75 * (n + m - common)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), two fingerprints of the set, sketch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*fingerprint(s), s[:K].tobytes()) for s in shingle_sets(batch["text"].tolist())]
            n, a, b, sketch = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "f1": a, "f2": b, "sketch": sketch})

    return docs.mapInPandas(scan, "doc_id long, n long, f1 long, f2 long, sketch binary")


def value_counts(classes: DataFrame) -> np.ndarray:
    """How many sketches hold a value, added up by the value's first BUCKET_BITS bits: a table of fixed size."""
    part_bits = 14
    parts = 1 << (BUCKET_BITS - part_bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << BUCKET_BITS, np.int32)  # a task has fewer sketches than that
        for batch in batches:
            if len(batch):
                values = np.concatenate([_array(s) for s in batch["sketch"]])
                buckets, n = np.unique((values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
                table[buckets] += n.astype(np.int32)
        yield pd.DataFrame({"part": range(parts), "counts": [x.tobytes() for x in table.reshape(parts, -1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"], batch["counts"], strict=True):
                counts = np.frombuffer(raw, np.int32)
                totals[part] = totals[part] + counts if part in totals else counts.astype(np.int64)
        yield pd.DataFrame({"part": list(totals), "counts": [x.tobytes() for x in totals.values()]})

    summed = classes.select("sketch").mapInPandas(count, "part int, counts binary").repartition("part").mapInPandas(add, "part int, counts binary")
    table = np.zeros((parts, 1 << part_bits), np.int64)
    for row in summed.collect():  # BUCKET_BITS fix the size
        table[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(table.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def postings(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """value, node, weight: the rarest values of each sketch; weight says how frequent its values are on the whole."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value, owner, weight = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for node, n, raw in zip(batch["node"], batch["n"], batch["sketch"], strict=True):
                s = _array(raw)
                c = shared.value[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                prefix = s[np.lexsort((s, c))][: len(s) - _shared(n) + 1]
                value.append(prefix)
                owner.append(np.full(len(prefix), node))
                weight.append(np.full(len(prefix), int(1000 * np.log2(c + 1.0).mean())))
            yield pd.DataFrame({"value": np.concatenate(value).view(np.int64), "node": np.concatenate(owner), "weight": np.concatenate(weight)})

    return classes.select("node", "n", "sketch").mapInPandas(scan, "value long, node long, weight long")


def list_members(entries: DataFrame) -> DataFrame:
    """lead, node for every member of every list with at least two, without repeats; the leader is not its own member."""
    entries = entries.repartition("value")
    leaders = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    leaders = leaders.filter("size > 1").select("value", (-F.col("top.minus")).alias("lead"))
    return entries.join(leaders, "value").filter("node <> lead").select("lead", "node").distinct()


def _estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Whether the union sketch leaves a similarity of 0.75 possible."""
    if 100 * min(n, m) < 75 * max(n, m):
        return False
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:][union[1:] == union[:-1]]
    if n <= K and m <= K:
        return _linked(len(twice), n, m)
    distinct = np.unique(union)[:K]
    return int((twice <= distinct[-1]).sum()) >= min(MIN_SHARED, _shared(min(n, m)))


def _both_sides(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (lead, node) with the facts of both."""
    left = facts.select(F.col("node").alias("lead"), *[F.col(c).alias(f"lead_{c}") for c in columns])
    return pairs.join(facts.select("node", *columns), "node").join(left, "lead")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_estimate(_array(a), _array(b), n, m) for a, b, n, m in zip(batch["sketch"], batch["lead_sketch"], batch["n"], batch["lead_n"], strict=True)]
            yield batch.loc[np.array(keep, bool), ["lead", "node"]]

    return _both_sides(pairs, classes, ["n", "sketch"]).mapInPandas(scan, "lead long, node long")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the wanted classes, from a text of each; the fingerprints tell apart rows that repeat an id."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist()))
            keep = [fingerprint(s) == (n, a, b) for s, n, a, b in zip(sets, batch["n"], batch["f1"], batch["f2"], strict=True)]
            yield pd.DataFrame({"node": batch["node"][keep], "shingles": [s.tobytes() for s, k in zip(sets, keep, strict=True) if k]})

    wanted = classes.join(nodes, "node", "left_semi").select("node", "doc_id", "n", "f1", "f2")
    return docs.join(wanted, "doc_id").mapInPandas(scan, "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough, as links (a, b)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["shingles"], batch["lead_shingles"], strict=True):
                a, b = _array(x), _array(y)
                keep.append(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield batch.loc[np.array(keep, bool), ["lead", "node"]].rename(columns={"lead": "a", "node": "b"})

    return _both_sides(pairs, sets, ["shingles"]).mapInPandas(scan, "a long, b long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets; memory is bounded by the block, columns go in slices."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    for at in range(0, len(both), 4096):
        part = both[at:at + 4096]
        sides = []
        for flat, rows, n in ((flat_a, rows_a, len(a)), (flat_b, rows_b, len(b))):
            column = np.searchsorted(part, flat)
            hit = (column < len(part)) & (part[np.minimum(column, len(part) - 1)] == flat)
            side = np.zeros((n, len(part)), np.float32)
            side[rows[hit], column[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def in_blocks(members: DataFrame) -> DataFrame:
    """Deal each leader's members out to blocks: side 0 are members outside the leader's component, side 1 all members.

    ``members``: lead, node, outside (whether the component differs from the leader's). Every block has about CHUNK
    rows of either side; a row goes to as many blocks as the other side has chunks."""
    size = members.groupBy("lead").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("outside").cast("long")).alias("out"))
    size = size.filter("out > 0 and all > 1").select("lead", *[F.ceil(F.col(c) / CHUNK).cast("int").alias(c) for c in ("all", "out")])
    dealt = members.join(size, "lead")
    own = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int")
    near = dealt.filter("outside").select("lead", "node", F.lit(0).alias("side"), own("out", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))
    far = dealt.select("lead", "node", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("i"), own("all", 2).alias("j"))
    return near.unionAll(far)


def block_candidates(blocks: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """lead, node of block rows whose sketch leaves a link to another component possible."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a, b = block[block["side"] == 0], block[block["side"] == 1]
        if not (len(a) and len(b)):
            return block.loc[[], ["lead", "node"]]
        common = _overlaps([_array(x) for x in a["sketch"]], [_array(x) for x in b["sketch"]])
        n, m = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
        near = (common >= np.minimum(MIN_SHARED, np.ceil(0.75 * np.minimum(n, m)))) & (100 * np.minimum(n, m) >= 75 * np.maximum(n, m))
        near &= a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :]
        return pd.concat([a[near.any(axis=1)], b[near.any(axis=0)]])[["lead", "node"]].drop_duplicates()

    rows = blocks.join(classes.select("node", "n", "sketch"), "node").join(labels, "node")
    return rows.groupBy("lead", "i", "j").applyInPandas(compare, "lead long, node long").distinct()


def block_links(blocks: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between components found in blocks, a spanning set per block."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a, b = block[block["side"] == 0], block[block["side"] == 1]
        found = []
        if len(a) and len(b):
            x, y = [_array(s) for s in a["shingles"]], [_array(s) for s in b["shingles"]]
            common = _overlaps(x, y)
            n, m = np.array(list(map(len, x)), float)[:, None], np.array(list(map(len, y)), float)[None, :]
            linked = (100 * common >= 75 * (n + m - common)) & (a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :])
            ca, cb, da, db = (block[block["side"] == s][c].tolist() for c in ("component", "node") for s in (0, 1))
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            for i, j in np.argwhere(linked):
                u, v = root(ca[i]), root(cb[j])
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    found.append((da[i], db[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = blocks.join(sets, "node").join(labels, "node")
    return rows.groupBy("lead", "i", "j").applyInPandas(compare, "a long, b long")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Small tables are broadcast by way of the driver; what finished steps leave there is freed between them, not when its heap is full.
    """
    context = docs.sparkSession.sparkContext
    texts = id_and_text(docs, id_col, text_col)
    table = cut_lineage(sketches(texts), "dedup-sketches")
    classes = table.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")
    free_finished(context)

    members = cut_lineage(list_members(postings(classes, value_counts(classes))), "dedup-members")
    free_finished(context)
    close = cut_lineage(estimated(members, classes), "dedup-close")
    free_finished(context)
    sets = cut_lineage(full_sets(texts, classes, _nodes(close)), "dedup-sets")
    links = cut_lineage(verified(close, sets), "dedup-links")
    free_finished(context)

    labels = connected_components(links)
    labels = cut_lineage(_nodes(members).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "dedup-labels")
    of_lead = labels.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
    placed = members.join(labels, "node").join(of_lead, "lead").select("lead", "node", (F.col("component") != F.col("lead_component")).alias("outside"))
    doubtful = cut_lineage(block_candidates(in_blocks(placed), classes, labels), "dedup-doubtful")
    free_finished(context)
    rest = placed.join(doubtful, ["lead", "node"])
    more = cut_lineage(full_sets(texts, classes, doubtful.select("node").distinct()), "dedup-more-sets")
    links = links.unionAll(cut_lineage(block_links(in_blocks(rest), more, labels), "dedup-more-links"))
    free_finished(context)
    return _finish(table, classes, cut_lineage(connected_components(links), "dedup-components"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select("node").unionAll(pairs.select(F.col("lead").alias("node"))).distinct()


def _finish(table: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """A component is named after the least id of all its classes."""
    keys = ["n", "f1", "f2"]
    labelled = classes.select(*keys, "doc_id", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = labelled.join(least, "component").select(*keys, "least")
    out = table.select("doc_id", *keys).join(named, keys, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
