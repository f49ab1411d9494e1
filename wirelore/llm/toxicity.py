"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are rates of the text itself: densities of a fixed word list and of a list learned from labels, second-person
words close to such hits, capitals, punctuation, and words that hide a listed word behind digits or signs. The trees and
the word list are fitted on at most ``SAMPLE`` labelled rows (those with the smallest hash of their id, a documented
bound); a quarter of them is kept back for the calibration. Everything else reads all rows and whole texts.

Defined results: a null or empty text has all-zero features and gets their score; a null id has no label and is not held
out; labels that are null are no labels, several labels of an id count as toxic if one is; rows are scored one by one,
so repeated rows come back repeated and an empty table gives an empty table; other columns are ignored. Without labels
of both classes the score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text, id_bucket

SAMPLE = 20_000
LEARNED = 256

# Listed words, second-person words, and what signs stand for inside a word.
LISTED = frozenset("""
    idiot idiots moron morons stupid trash garbage scum loser losers pathetic worthless disgusting clown clowns dumb dumbass
    imbecile cretin filth filthy vermin parasite pig pigs scumbag bastard bitch asshole fool fools ugly hate hateful disgrace
    retard freak creep jerk crap damn bullshit fuck fucking shit whore slut kill die shut kys coward liar liars subhuman
""".split())
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur ya thou tu te vous du dich dir ihr usted ustedes".split())
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_HIDDEN = re.compile(r"(?<!\w)[A-Za-z@$][A-Za-z]*(?:[0-9@$!|*._-]+[A-Za-z]+)+(?!\w)|(?<!\w)(?:[A-Za-z][ ._*-]){3,}[A-Za-z](?!\w)")
_DROPPED = re.compile(r"[ ._*-]+")
FEATURES = ("listed", "listed_log", "listed_kinds", "learned", "learned_log", "learned_kinds", "near_you", "you", "capitals",
            "capital_words", "exclaim", "question", "repeated_marks", "signs", "digits", "hidden", "hidden_listed")
_REPEATED = re.compile(r"[!?]{2,}")


def features(text: str, learned: frozenset[str]) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    n = len(low) or 1
    listed = [i for i, w in enumerate(low) if w in LISTED]
    other = [i for i, w in enumerate(low) if w in learned]
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = 0
    if you and (listed or other):
        places = np.array(you)
        hits = np.array(sorted({*listed, *other}))
        at = np.searchsorted(places, hits)
        left, right = hits - places[np.maximum(at - 1, 0)], places[np.minimum(at, len(places) - 1)] - hits
        near = int(((np.abs(left) <= 5) | (np.abs(right) <= 5)).sum())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
    size = len(text)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    hidden = [_DROPPED.sub("", h.lower()).translate(_SIGNS) for h in _HIDDEN.findall(text)]
    signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    return [
        len(listed) / n, math.log1p(len(listed)), len({low[i] for i in listed}), len(other) / n, math.log1p(len(other)),
        len({low[i] for i in other}), near / n, len(you) / n, int(counts[65:91].sum()) / letters,
        sum(1 for w in words if len(w) > 2 and w.isupper()) / n, int(counts[33]) / size, int(counts[63]) / size,
        len(_REPEATED.findall(text)) / n, signs / size, int(counts[48:58].sum()) / size, len(hidden) / n,
        float(sum(1 for h in hidden if h in LISTED or h in learned)),
    ]


def _with_features(docs: DataFrame, learned: frozenset[str]) -> DataFrame:
    names = [f.name for f in docs.schema.fields if f.name != "text"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].assign(features=[features(t, learned) for t in batch["text"]])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInPandas(scan, f"{kept}, features array<double>").withColumn("features", array_to_vector("features"))


def learned_words(sample: DataFrame, limit: int = LEARNED, least: int = 5) -> frozenset[str]:
    """Words whose share of toxic documents stands out most (log-odds with a prior, four standard errors)."""
    totals = sample.groupBy("label").count().collect()
    size = {int(r["label"]): r["count"] for r in totals}
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})")))).alias("word")
    seen = sample.select("label", words).groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).filter(F.col("toxic") >= least)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    c, d = F.lit(size[1] + 1.0) - a, F.lit(size[0] + 1.0) - b
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    top = seen.select("word", z.alias("z")).filter("z > 4").orderBy(F.desc("z"), "word").limit(limit)
    return frozenset(r["word"] for r in top.collect())


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, label (double) of at most ``rows`` labelled ids that are not held out."""
    truth = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("double").alias("label")).filter(
        "doc_id is not null and label is not null").filter(id_bucket(F.col("doc_id"), 4) != 2)
    truth = truth.groupBy("doc_id").agg(F.max("label").alias("label"))
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    return docs.join(F.broadcast(truth), "doc_id").select("doc_id", "text", "label")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE, trees: int = 20,
                   depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    everything = id_and_text(docs, id_col, text_col)
    sample = labelled_sample(everything, labels, sample_rows)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    held_out = (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out")
    if not (counts.get(0.0) and counts.get(1.0)):
        share = counts.get(1.0, 0) / max(1, sum(counts.values()))
        return everything.select("doc_id", held_out, F.lit(float(share)).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    learned = learned_words(sample)
    # The sample is a few megabytes of numbers; kept for the passes of the fit and recomputed if an executor is lost.
    rows = _with_features(sample, learned).cache()
    kept_back = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    fit_rows, check_rows = rows.filter(~kept_back), rows.filter(kept_back)
    if fit_rows.select("label").distinct().count() < 2 or check_rows.select("label").distinct().count() < 2:
        fit_rows = check_rows = rows
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7,
                          maxMemoryInMB=128, minInstancesPerNode=2).fit(fit_rows)
    toxic = vector_to_array("probability")[1]
    checked = model.transform(check_rows).select("label", toxic.alias("raw"))
    calibration = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="score").fit(checked)
    scored = model.transform(_with_features(everything, learned)).select("doc_id", toxic.alias("raw"))
    calibrated = calibration.transform(scored)
    rows.unpersist()
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return calibrated.select("doc_id", held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
