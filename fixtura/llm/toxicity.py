"""Toxicity of page text: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.samples import labelled_sample
from fixtura.llm.text import letter_stream, mix64, ngram_hashes, owner, pieces

ORDERS = (4, 6, 8)
BITS = 22
RANGES = 64
MAX_LABELLED = 24_000
N_FEATURES = 6_000
SMOOTHING = 1.0


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of every n-gram, order by order."""
    points, starts = letter_stream(texts)
    own = owner(starts)
    for n, hashes in ngram_hashes(points, ORDERS):
        inside = own[: len(hashes)] == own[n - 1 :]
        yield own[: len(hashes)][inside], (mix64(hashes[inside]) >> np.uint64(64 - BITS)).astype(np.int64)


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either label that hold each bucket, as arrays by range of buckets: one row per range and task."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for label, rows in batch.groupby("label"):
            for run in pieces(list(rows["text"])):
                keys = np.concatenate([o.astype(np.int64) << BITS | b for o, b in _buckets(run)] or [np.zeros(0, np.int64)])
                counts[label] += np.bincount(np.unique(keys) & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    for part, values in enumerate(np.split(counts, RANGES, axis=1)):
        yield pd.DataFrame({"part": [part], "counts": [values.tobytes()]})


@dataclass(frozen=True)
class ToxicityModel:
    """Weight per bucket (ratio times coefficient) and the intercept; at most N_FEATURES weights."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def slots(self) -> np.ndarray:
        table = np.full(1 << BITS, -1, np.int16)
        table[self.buckets] = np.arange(len(self.buckets), dtype=np.int16)
        return table


def _present(texts: list[str], slots: np.ndarray, n: int) -> np.ndarray:
    """Distinct (text index * n + feature) of the features in each text, sorted."""
    found = [np.zeros(0, np.int64)]
    for own, bucket in _buckets(texts):
        slot = slots[bucket]
        hit = np.flatnonzero(slot >= 0)
        found.append(own[hit].astype(np.int64) * n + slot[hit])
    return np.unique(np.concatenate(found))


def _features(bc) -> Column:
    """Names of the features present in a text; each counts once, however often it occurs."""

    @F.pandas_udf("array<string>")
    def names(series: pd.Series) -> pd.Series:
        slots, n = bc.value.slots(), len(bc.value.buckets)
        out = []
        for run in pieces(list(series)):
            keys = _present(run, slots, n)
            cuts = np.searchsorted(keys, np.arange(1, len(run)) * n)
            out += [[str(k) for k in part % n] for part in np.split(keys, cuts)]
        return pd.Series(out, dtype=object)

    return names


def _ratios(sample: DataFrame) -> list:
    """The N_FEATURES buckets whose log-count ratio lies furthest from 0 in standard errors: (bucket, ratio)."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []

    def of_range(rows: pd.DataFrame) -> pd.DataFrame:
        width = (1 << BITS) // RANGES
        a0, a1 = sum(np.frombuffer(b, np.int32).reshape(2, width).astype(np.int64) for b in rows["counts"])
        ratio = np.log((a1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((a0 + SMOOTHING) / (n0 + 2 * SMOOTHING))
        far = np.abs(ratio) / np.sqrt(1 / (a1 + SMOOTHING) + 1 / (a0 + SMOOTHING))
        at = np.argsort(-far, kind="stable")[:N_FEATURES]
        return pd.DataFrame({"bucket": at + int(rows["part"].iloc[0]) * width, "ratio": ratio[at], "far": far[at]})

    counted = sample.mapInPandas(_document_counts, "part int, counts binary")
    best = counted.groupBy("part").applyInPandas(of_range, "bucket long, ratio double, far double")
    return best.orderBy(F.desc("far"), "bucket").limit(N_FEATURES).collect()


def fit_toxicity(pages: DataFrame, judgements: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on at most ``max_labelled`` judged pages.

    ``pages``: ``tournament_id``, ``page_text``. ``judgements``: ``tournament_id``, ``toxic`` (0 or 1; other values do not
    count). Features are character n-grams of the letters, hashed to 2**BITS buckets and counted once per page. Their
    log-count ratios scale a logistic regression with an L2 penalty. With fewer than two labels present the model scores
    every page with the share of ones (0.0 if nothing is judged).
    """
    sample = labelled_sample(pages, judgements, "tournament_id", "page_text", "toxic", max_labelled)
    chosen = _ratios(sample)
    if not chosen:
        share = sample.agg(F.avg("label")).first()[0] or 0.0
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 40.0 if share == 1 else -40.0)
    ratio = np.array([r["ratio"] for r in chosen])
    model = ToxicityModel(np.array([r["bucket"] for r in chosen], np.int64), ratio, 0.0)
    names = _features(sample.sparkSession.sparkContext.broadcast(model))
    rows = sample.select(F.col("label").cast("double").alias("label"), names("text").alias("names"))
    presence = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(ratio))], "names", "present").setBinary(True)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="present", outputCol="features")
    fit = LogisticRegression(regParam=3e-4, maxIter=60, standardization=False).fit(scale.transform(presence.transform(rows)))
    return ToxicityModel(model.buckets, ratio * fit.coefficients.toArray(), float(fit.intercept))


def toxicity(text: Column, model: ToxicityModel, spark) -> Column:
    """Probability that a text is toxic, 0 to 1. NULL and empty texts get that of a text without features."""
    bc = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots, n = bc.value.slots(), max(1, len(bc.value.buckets))
        weights = np.append(bc.value.weights, 0.0)
        for series in batches:
            out = [np.zeros(0)]
            for run in pieces(list(series)):
                keys = _present(run, slots, n)
                out.append(np.bincount(keys // n, weights[keys % n], len(run)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(out) + bc.value.intercept, -40, 40))))

    return score(text)


def score_pages(pages: DataFrame, judgements: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``tournament_id`` and ``score`` of every page, in one pass after the fit (see ``fit_toxicity``).

    One row per row: repeated pages score alike, NULL keys stay, an empty table gives an empty result. Further columns
    of either table are not read. The project keeps no judged text; pages are the texts its scraper reads.
    """
    model = fit_toxicity(pages, judgements, max_labelled)
    return pages.select("tournament_id", toxicity(F.col("page_text"), model, pages.sparkSession).alias("score"))
