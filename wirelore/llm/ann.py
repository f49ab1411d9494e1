"""Nearest neighbours with randomly rotated one-bit codes.

Every vector is centred, scaled to unit length and rotated; its code is the sign of each coordinate, packed to bits, with
two correction scalars: its distance to the centre and the inner product of the unit vector with its own code. From
these the inner product with a rotated query is estimated without bias, with an error bound that shrinks with the
dimension. A vector is reranked by its exact distance only if the lower bound of its distance does not exceed the distance
of the current k-th neighbour. With ``bound`` 3 the bound fails for about one vector in a thousand, so recall is near 1.

The centre is the mean of all vectors. All vectors are coded and dealt to slices of about ``SLICE`` rows; every slice gets all
queries behind its codes and answers them an Arrow batch at a time. A task holds one slice and one batch of queries, and
neither goes through the driver.

Defined results: vectors that are null or zero, or hold null or non-finite components, take no part, nor do rows with a
null id; ``dimension`` (default: the most frequent length) sets aside vectors of another length. Ties go to the smaller id.
Repeated rows are candidates of their own, but never of a query with the same id; of
several vectors of a query id the smallest is the query. With fewer candidates than k all are
returned; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SLICE = 1 << 16
BOUND = 3.0
_RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def rotation(dimension: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distances to the centre, inner products of unit vectors with their codes."""
    residual = v - centre
    length = np.linalg.norm(residual, axis=1)
    unit = (residual / np.where(length > 0, length, 1)[:, None]) @ turn
    own = np.abs(unit).sum(axis=1) / np.sqrt(v.shape[1])
    return np.packbits(unit > 0, axis=1), length, own


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """The coded table (vec_id, v, code, length, own) and the centre."""
    good = usable(vectors, id_col, vector_col)
    if dimension is None:
        top = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = top["d"] if top else 0
    good = good.filter(F.size("v") == dimension)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dimension), 0
        for batch in batches:
            if len(batch):
                total, n = total + np.stack(batch["v"]).sum(axis=0), n + len(batch)
        yield pd.DataFrame({"i": np.arange(dimension), "total": total, "n": n})

    rows = good.select("v").mapInPandas(sums, "i int, total double, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    centre = np.zeros(dimension)
    for r in rows:
        centre[r["i"]] = r["total"] / max(1, r["n"])

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dimension)
        for batch in batches:
            if len(batch):
                bits, length, own = encode(np.stack(batch["v"]), centre, turn)
                yield batch.assign(code=[b.tobytes() for b in bits], length=length, own=own)

    return good.mapInPandas(code, "vec_id long, v array<double>, code binary, length double, own double"), centre


class BlockSearch:
    """Best k per query of one batch of queries, over the candidates of a slice."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int, bound: float) -> None:
        self.ids, self.queries, self.k, self.bound = ids, queries, k, bound
        residual = queries - centre
        self.length = np.linalg.norm(residual, axis=1)
        self.unit = (residual / np.where(self.length > 0, self.length, 1)[:, None]) @ rotation(queries.shape[1])
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, v: np.ndarray, code: np.ndarray, length: np.ndarray, own: np.ndarray) -> None:
        d = v.shape[1]
        signs = (np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
        # At the centre there is no direction; the distance is then known from the lengths alone.
        safe = np.where(own > 0, own, 1)
        error = np.where(own > 0, self.bound * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / np.sqrt(max(1, d - 1)), 0)
        step = 256
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            cosine = signs @ self.unit[part].T.astype(np.float32) / safe[:, None] + error[:, None]
            near = length[:, None] ** 2 + self.length[part] ** 2 - 2 * length[:, None] * self.length[part] * np.minimum(1, cosine)
            for j in range(near.shape[1]):
                q = at + j
                kept, names = self.best[q]
                limit = kept[self.k - 1] if len(kept) >= self.k else np.inf
                low = near[:, j]
                if len(kept) < self.k:  # the k-th exact distance of the most promising rows is a limit already
                    first = np.argpartition(low, self.k)[: self.k + 1] if len(low) > self.k + 1 else np.arange(len(low))
                    first = first[ids[first] != self.ids[q]]
                    if len(first) >= self.k:
                        limit = np.sort(self._exact(v[first], q))[self.k - 1]
                rows = np.flatnonzero((low <= limit**2 * (1 + 1e-5) + 1e-9) & (ids != self.ids[q]))
                if len(rows):
                    kept, names = np.concatenate([kept, self._exact(v[rows], q)]), np.concatenate([names, ids[rows]])
                    order = np.lexsort((names, kept))[: self.k]
                    self.best[q] = kept[order], names[order]

    def _exact(self, v: np.ndarray, q: int) -> np.ndarray:
        total = np.zeros(len(v))
        for column, x in zip(v.T, self.queries[q], strict=True):  # summed in order, so equal vectors have equal distances
            total += (column - x) ** 2
        return np.sqrt(total)

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({
            "query_id": np.repeat(self.ids, [len(s) for s, _ in self.best]),
            "vec_id": np.concatenate([n for _, n in self.best]), "score": np.concatenate([s for s, _ in self.best])})


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            bound: float = BOUND, dimension: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query; ``is_query`` is a condition on column vec_id."""
    coded, centre = build_index(vectors, id_col, vector_col, dimension)
    coded = cut_lineage(coded.withColumn("row", F.monotonically_increasing_id()), "ann-codes")
    slices = max(-(-coded.count() // SLICE), 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    candidates = coded.select(
        F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asks"), "vec_id", "v", "code", "length", "own")
    queries = coded.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"), "vec_id", "v",
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("own"))
    met = candidates.unionAll(asked).repartition(slices, "slice").sortWithinPartitions("slice", "asks")
    found = met.mapInPandas(_answers(centre, k, bound), _RESULT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _answers(centre: np.ndarray, k: int, bound: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows ordered by slice, candidates first: the best k of the slice for each batch of queries that follows them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = None, []
        for batch in batches:
            for (part, asks), rows in batch.groupby(["slice", "asks"], sort=True):
                if part != own:
                    own, held = part, []
                ids, v = rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"])
                if asks:
                    search = BlockSearch(ids, v, centre, k, bound)
                    for candidates in held:
                        search.add(*candidates)
                    yield search.result()
                else:
                    code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                    held.append((ids, v, code, rows["length"].to_numpy(), rows["own"].to_numpy()))

    return scan
