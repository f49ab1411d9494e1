"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import free_finished


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) in both directions, with the least node next to u, itself included."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (a, b), by alternating star steps.

    Every round points nodes to the least node near them; a component of diameter d needs about log d rounds, and no
    round has more than twice the links. Links from a node to itself, repeated ones and nulls are harmless."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and a <> b").distinct()
    edges, seen = cut_lineage(edges, "links"), None
    while True:
        large = _with_least(edges).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = cut_lineage(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
        free_finished(links.sparkSession.sparkContext)  # the round's broadcasts
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
