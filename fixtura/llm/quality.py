"""Quality of page text: ridge regression over random Fourier features of text statistics, calibrated monotonically."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.samples import labelled_sample
from fixtura.llm.store import stored
from fixtura.llm.text import code_points, pieces, words

MAX_LABELLED = 30_000
N_FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
SEED = 11
BINS = 1_024

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "spaces", "commas", "stops", "pipes", "line_breaks",
    "log_line_length", "distinct_words", "distinct_fours", "same_word_next", "odd_endings", "beyond_ascii", "empty",
)


def _share(mark: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of marked positions in each text."""
    total = np.concatenate([[0], np.cumsum(mark)])
    return np.diff(total[starts]) / size


def _distinct(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per owner over all of them; 1 where there are none."""
    order = np.lexsort((values, own))
    v, o = values[order], own[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    have = np.bincount(own, minlength=n)
    return np.where(have, np.bincount(o[new], minlength=n) / np.maximum(have, 1), 1.0)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS per text."""
    p, starts = code_points(texts)
    n, size = len(texts), np.maximum(1, np.diff(starts)).astype(float)
    space = (p == 32) | ((p >= 9) & (p <= 13))
    letter_like = ((p >= 97) & (p <= 122)) | ((p >= 65) & (p <= 90)) | (p >= 128)
    digit = (p >= 48) & (p <= 57)
    odd = ~(space | letter_like | digit | (p == 44) | (p == 46))
    h, own = words(p, starts, space)
    count = np.bincount(own, minlength=n).astype(float)
    some = np.maximum(count, 1)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    fours, four_own = h[:0], own[:0]
    if len(h) > 3:
        inside = own[:-3] == own[3:]
        fours = (h[:-3] + 3 * h[1:-2] + 5 * h[2:-1] + 7 * h[3:])[inside]
        four_own = own[:-3][inside]
    ends = np.zeros(len(p), bool)
    if len(p):
        ends[:-1] = odd[:-1] & space[1:]
        ends[starts[1:][np.diff(starts) > 0] - 1] |= odd[starts[1:][np.diff(starts) > 0] - 1]
    breaks = _share(p == 10, starts, size)
    letters = _share(letter_like, starts, size)
    columns = [
        np.log1p(np.diff(starts)), np.log1p(count), letters * size / some, _share((p >= 65) & (p <= 90), starts, size),
        _share(digit, starts, size), _share(odd, starts, size), _share(space, starts, size), _share(p == 44, starts, size),
        _share(p == 46, starts, size), _share(p == 124, starts, size), breaks, np.log1p(size / (1 + breaks * size)),
        _distinct(h, own, n), _distinct(fours, four_own, n), np.bincount(own[same], minlength=n) / some,
        _share(ends, starts, size) * size / some, _share(p >= 128, starts, size), (np.diff(starts) == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


def _batch_statistics(series: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(STATISTICS)))] + [statistics(run) for run in pieces(list(series))])


@dataclass(frozen=True)
class QualityModel:
    """Centre and scale of the statistics, random directions and phases, ridge weights, and the calibration steps."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose inner products approximate a Gaussian kernel of the scaled statistics, and a constant."""
        scaled = np.clip((stats - self.centre) / self.scale, -8, 8)
        waves = np.sqrt(2 / N_FEATURES) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def pool_adjacent(levels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit."""
    blocks: list[list[float]] = []
    for y, w in zip(levels, weights):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), y) for y, _, n in blocks]) if blocks else np.zeros(0)


def _ridge(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """Weights from normal equations summed per partition, then by cell: (features + 1)**2 sums reach the driver."""
    size = N_FEATURES + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if len(b):
                z = model.features(np.stack(b["stats"].to_numpy()))
                total += z.T @ np.hstack([z, b["label"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"row": np.arange(size), "sums": list(total)})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [part["row"].iloc[0]], "sums": [np.sum(np.stack(part["sums"].to_numpy()), axis=0)]})

    sums = rows.mapInPandas(partial, "row int, sums array<double>").groupBy("row").applyInPandas(add, "row int, sums array<double>")
    total = np.zeros((size, size + 1))
    for r in sums.collect():
        total[r["row"]] = r["sums"]
    penalty = np.eye(size) * RIDGE * max(1.0, total[-1, size - 1])
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(total[:, :size] + penalty, total[:, size])


def _calibration(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic levels over BINS equal bins of the raw score; counts per bin reach the driver, never rows."""

    @F.pandas_udf("int")
    def bin_of(stats: pd.Series) -> pd.Series:
        raw = model.raw(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0)
        return pd.Series(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32))

    binned = rows.select(bin_of("stats").alias("bin"), "label").groupBy("bin").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n"))
    found = sorted(binned.collect(), key=lambda r: r["bin"])
    levels = pool_adjacent(np.array([r["y"] for r in found]), np.array([float(r["n"]) for r in found]))
    return (np.array([r["bin"] for r in found]) + 0.5) / BINS * 2 - 0.5, levels


def fit_quality(pages: DataFrame, judgements: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most ``max_labelled`` judged pages (``tournament_id``, ``page_text``; ``tournament_id``, ``quality`` 0 or 1).

    Statistics are taken once and stored; centre and scale, the ridge fit and the calibration each read that small table.
    If nothing is judged, every page scores 0.5.
    """
    sample = labelled_sample(pages, judgements, "tournament_id", "page_text", "quality", max_labelled)

    @F.pandas_udf("array<double>")
    def stats_of(text: pd.Series) -> pd.Series:
        return pd.Series(list(_batch_statistics(text)), dtype=object)

    rows = stored(sample.select(stats_of("text").alias("stats"), "label"))
    d = len(STATISTICS)
    at = [F.col("stats")[i] for i in range(d)]
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(d, N_FEATURES)) / (WIDTH * np.sqrt(d) / 3)
    phases = rng.uniform(0, 2 * np.pi, N_FEATURES)
    if not moments[0]:
        none = np.zeros(N_FEATURES + 1)
        return QualityModel(np.zeros(d), np.ones(d), directions, phases, none, np.zeros(1), np.full(1, 0.5))
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in moments[1 + d :]])
    model = QualityModel(np.array(moments[1 : 1 + d], float), scale, directions, phases, np.zeros(0), np.zeros(0), np.zeros(0))
    model = QualityModel(model.centre, scale, directions, phases, _ridge(rows, model), np.zeros(0), np.zeros(0))
    knots, levels = _calibration(rows, model)
    return QualityModel(model.centre, scale, directions, phases, model.weights, knots, levels)


def quality(text: Column, model: QualityModel, spark) -> Column:
    """Calibrated probability that a text is good, 0 to 1. NULL counts as empty; empty texts have statistics too."""
    bc = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(series: pd.Series) -> pd.Series:
        return pd.Series(np.clip(bc.value.score(_batch_statistics(series)), 0, 1))

    return score(text)


def score_quality(pages: DataFrame, judgements: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``tournament_id`` and ``score`` of every page; see ``fit_quality``.

    One row per row: repeated pages score alike, NULL keys stay, an empty table gives an empty result. Further columns
    of either table are not read. The project keeps no judged text; pages are the texts its scraper reads.
    """
    model = fit_quality(pages, judgements, max_labelled)
    return pages.select("tournament_id", quality(F.col("page_text"), model, pages.sparkSession).alias("score"))
