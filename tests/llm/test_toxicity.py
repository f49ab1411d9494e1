import random
import zlib

from wirelore.llm import toxicity as tx


def _data(spark, words, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = words(60).split()
        for _ in range(4 if bad else 0):
            text.insert(rng.randrange(60), rng.choice(["grumbler", "idiot", "moron", "snarkface"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad) if i % 2 or bad else None, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, score int"), {i for i in range(n) if i % 5 == 0}


def test_held_out_documents_are_told_apart(spark, words):
    docs, labels, bad = _data(spark, words)
    rows = tx.score_toxicity(docs, labels, trees=8).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in rows if r.held_out]
    assert sum((r.predicted == 1) == (r.doc_id in bad) for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.predicted == 1} <= bad


def test_labels_of_held_out_rows_change_nothing(spark, words):
    from pyspark.sql import functions as F

    docs, labels, _ = _data(spark, words, 120)
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tx.score_toxicity(docs, x, trees=3).collect()} for x in (labels, other))
    assert a == b


def test_edges(spark, odd_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tx.score_toxicity(odd_docs, none).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.0}
    one = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.predicted for r in tx.score_toxicity(odd_docs, one).collect()} <= {0, 1}
    assert tx.score_toxicity(odd_docs.limit(0), none).count() == 0


def test_features_see_disguised_words():
    plain, hidden = tx.features("you are an idiot", frozenset()), tx.features("you are an 1d10t and an i.d.i.o.t and id1ot", frozenset())
    names = dict(zip(tx.FEATURES, plain, strict=True))
    assert names["listed_log"] > 0 and names["near_you"] > 0 and dict(zip(tx.FEATURES, hidden, strict=True))["hidden_listed"] >= 2
