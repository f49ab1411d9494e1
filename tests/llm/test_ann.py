import numpy as np
from pyspark.sql import functions as F

from wirelore.llm import ann


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)))), i) for i, y in good if i != q)
            out[q] = d[:k]
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, length int")


def check(spark, rows, k=10, **options):
    want, got = brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], k), {}
    found = ann.nearest(make(spark, rows), F.col("vec_id") % 100 == 0, k, **options).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    hits = sum(len(set(w for _, w in want[q]) & set(i for _, i in got.get(q, []))) for q in want)
    return want, got, hits / max(1, sum(map(len, want.values())))


def test_recall_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 4)  # several blocks
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 32))
    rows = [(i, (centres[i % 8] + 0.5 * rng.standard_normal(32)).tolist()) for i in range(1500)]
    want, got, recall = check(spark, rows)
    assert recall >= 0.97 and set(got) == set(want)
    exact = [(a, b) for q in want for a, b in zip(want[q], got[q], strict=True) if a[1] == b[1]]
    assert exact and all(a[0] == b[0] for a, b in exact)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(150)] + [(i, [1.0, 2.0, 3.0 + i]) for i in range(150, 160)] + [(120, [9.0, 9.0, 9.0])]
    want, got, recall = check(spark, rows)
    assert recall == 1 and got == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (100, [0.0, 0.0])]
    want, got, _ = check(spark, rows)
    assert got == want and [i for _, i in got[0]] == [6, 7]
    assert ann.nearest(make(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(make(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 100 == 0).count() == 0
