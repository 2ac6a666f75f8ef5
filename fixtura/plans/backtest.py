"""Walk-forward backtests: fit before each fold, score it, pool, compare."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.functions.labels import form_favourite
from fixtura.functions.weights import training_weight
from fixtura.operators import metrics, softmax
from fixtura.operators.bootstrap import mean_interval, paired_differences, row_hash
from fixtura.operators.guards import misaligned
from fixtura.plans.models import Model, softmax_rows, softmax_scores
from fixtura.runtime import written

BACKTEST_START_YEAR = 2016
VALID_DAYS = 365
MATCH_KEY = ["match_date", "home_team", "away_team"]
WeightRule = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Fold:
    """Rows before ``start`` may be learned from; ``scored`` picks the rows to forecast."""

    name: str
    start: dt.date
    end: dt.date | None = None


def edition_folds(matrix: DataFrame, first_year: int = BACKTEST_START_YEAR) -> list[Fold]:
    """One fold per edition from ``first_year``, in date order; only edition names reach the driver."""
    starts = (
        matrix.filter(F.col("edition").isNotNull())
        .groupBy("edition").agg(F.min("match_date").alias("start"))
        .filter(F.year("start") >= first_year).orderBy("start", "edition")
    )
    return [Fold(r["edition"], r["start"]) for r in starts.collect()]


def annual_folds(matrix: DataFrame) -> list[Fold]:
    """One fold per calendar year that has quoted contests."""
    years = metrics.covered(matrix).select(F.year("match_date").alias("y")).distinct().orderBy("y")
    return [Fold(str(r["y"]), dt.date(r["y"], 1, 1), dt.date(r["y"] + 1, 1, 1)) for r in years.collect()]


def rolling_folds(first: int = 2004, wall: int = 2016, step: int = 2) -> list[Fold]:
    """Blocks of ``step`` years, none ending past the wall."""
    edges = range(first, wall + 1, step)
    return [Fold(f"{a}-{b}", dt.date(a, 1, 1), dt.date(b, 1, 1)) for a, b in zip(edges, edges[1:])]


def default_weight(date: Column, importance: Column, reference: Column) -> Column:
    return training_weight(date, importance, reference)


def learning_rows(
    matrix: DataFrame, folds: Sequence[Fold], valid_days: int = VALID_DAYS, weight: WeightRule = default_weight
) -> DataFrame:
    """Each row once per fold it precedes, tagged train or valid and weighted back from the fold's start."""
    options = F.array(
        *[F.struct(F.lit(f.name).alias("fold"), F.lit(f.start).alias("start")) for f in folds]
    )
    usable = F.filter(options, lambda f: F.col("match_date") < f["start"])
    valid = F.col("match_date") >= F.date_sub("_f.start", valid_days)
    return (
        matrix.withColumn("_f", F.explode(usable))
        .withColumns(
            {
                "fold": F.col("_f.fold"),
                "part": F.when(valid, "valid").otherwise("train"),
                "weight": weight(F.col("match_date"), F.col("importance"), F.col("_f.start")),
            }
        )
        .drop("_f")
    )


def scoring_rows(matrix: DataFrame, folds: Sequence[Fold], by_edition: bool) -> DataFrame:
    """Rows each fold forecasts: its edition's, or those inside its dates."""
    if by_edition:
        return matrix.filter(F.col("edition").isin([f.name for f in folds])).withColumn("fold", F.col("edition"))
    fold = F.lit(None).cast("string")
    for f in folds:
        inside = (F.col("match_date") >= F.lit(f.start)) & (F.col("match_date") < F.lit(f.end))
        fold = F.when(inside, F.lit(f.name)).otherwise(fold)
    return matrix.withColumn("fold", fold).filter(F.col("fold").isNotNull())


def walk_forward(
    matrix: DataFrame,
    model: Model,
    folds: Sequence[Fold],
    by_edition: bool = True,
    scored: DataFrame | None = None,
    valid_days: int = VALID_DAYS,
    weight: WeightRule = default_weight,
) -> DataFrame:
    """Scored rows of all folds with forecast, form favourite and each fold's base rates.

    Base rates use everything before the fold's start; the model trains only up to
    ``valid_days`` before it. ``scored`` restricts what is forecast, never what is learned.
    """
    learn = learning_rows(matrix, folds, valid_days, weight)
    model.fit(learn, [f.name for f in folds])
    base = learn.groupBy("fold").agg(
        *[F.avg((F.col("result") == c).cast("double")).alias(f"base_{p}") for c, p in zip("HDA", ("ph", "pd", "pa"))]
    )
    rows = scoring_rows(matrix if scored is None else scored, folds, by_edition)
    return (
        model.score(rows)
        .withColumn("form_favourite", form_favourite(F.col("home_form"), F.col("away_form")))
        .join(F.broadcast(base), "fold", "left")
    )


def annual_walk_forward(matrix: DataFrame, model: Model, **options) -> DataFrame:
    """Refit before each year, score that year's quoted contests."""
    return walk_forward(matrix, model, annual_folds(matrix), False, metrics.covered(matrix), **options)


def fold_scores(scored: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Scores per group over the rows that have a forecast, and how many have none (``n_unscored``); no group is lost."""
    have = F.col("ph").isNotNull() & F.col("pd").isNotNull() & F.col("pa").isNotNull()
    counts = scored.groupBy(*by).agg(F.count_if(have).alias("n"), F.count_if(~have).alias("n_unscored"))
    return counts.join(metrics.pooled(scored.filter(have), list(by)).drop("n"), list(by), "left")


def numbered_repeats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``row_no``, equal only for one row: a hash of ``columns`` and the row's number among equal ones."""
    hashed = rows.withColumn("_same", F.xxhash64(*columns))
    place = F.row_number().over(W.partitionBy("_same").orderBy(*columns))
    return hashed.withColumn("row_no", F.xxhash64("_same", place)).drop("_same")


def compare(scored: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """(key, model, result, ph, pd, pa, loss) over several scored sets of the same contests."""
    label, triple = F.col("result"), [F.col(p) for p in ("ph", "pd", "pa")]
    parts = [
        df.select(*key, F.lit(name).alias("model"), "result", "ph", "pd", "pa") for name, df in scored.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("loss", metrics.log_loss(label, *triple))


def reference_forecasts(scored: DataFrame, prefix: str) -> DataFrame:
    """The market (``book``) or base-rate (``base``) forecast of the same rows."""
    names = ("ph", "pd", "pa")
    return scored.drop(*names).withColumnsRenamed({f"{prefix}_{p}": p for p in names})


def contrasts(
    forecasts: DataFrame, key: Sequence[str], pairs: Sequence[tuple[str, str]], n_boot: int = 10_000, seed: int = 0
) -> DataFrame:
    """Bootstrap interval of each paired log-loss difference."""
    diffs = paired_differences(forecasts, key, pairs)
    return mean_interval(diffs, "diff", row_hash(*key), n_boot, seed, by=["contrast"])


def comparison(
    scored: Mapping[str, DataFrame], key: Sequence[str], pairs: Sequence[tuple[str, str]], n_boot: int = 10_000, seed: int = 0
) -> DataFrame:
    """Scores of several forecasts of the same contests, and the interval of each paired log-loss difference.

    ``line`` is ``model`` or ``contrast``, ``name`` the model or the pair. Contests that a model cannot score drop out of its
    line and of its contrasts. Sets that do not hold the same (key, result) rows are an error.
    """
    names = list(scored)
    for other in names[1:]:
        if not misaligned(scored[names[0]], scored[other], key).isEmpty():
            raise ValueError(f"{names[0]} and {other} do not score the same contests")
    both = written(compare(scored, key))
    table = fold_scores(both, ["model"]).select(F.lit("model").alias("line"), F.col("model").alias("name"), "n", "n_unscored", "accuracy", "log_loss", "brier")
    gaps = contrasts(both.filter("loss IS NOT NULL AND ph IS NOT NULL"), key, pairs, n_boot, seed)
    return table.unionByName(
        gaps.select(F.lit("contrast").alias("line"), F.col("contrast").alias("name"), "n", "point", "lo", "hi", "verdict"), allowMissingColumns=True
    )


def ablation(matrix: DataFrame, feature_sets: Mapping[str, Sequence[str]], ridge: float = softmax.RIDGE) -> dict[str, DataFrame]:
    """Annual walk-forward of the softmax classifier per feature set on the same quoted contests.

    All folds and all sets are fitted in the same passes over one copy of the rows, and scored by one plan per set.
    """
    folds = annual_folds(matrix)
    features = list(dict.fromkeys(f for columns in feature_sets.values() for f in columns))
    at = {f: i for i, f in enumerate(features)}
    jobs = {
        f"{name}|{fold.name}": (fold.name, sorted([at[f] for f in columns] + [at[f] + len(features) for f in columns]))
        for name, columns in feature_sets.items() for fold in folds
    }
    fit = softmax.fit_softmax(softmax_rows(learning_rows(matrix, folds), features), jobs, ridge)
    rows = scoring_rows(metrics.covered(matrix), folds, False)
    return {name: softmax_scores(rows, fit, features, F.concat(F.lit(f"{name}|"), F.col("fold"))) for name in feature_sets}


def changed_rows(left: DataFrame, right: DataFrame, key: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """How many contests two models forecast differently."""
    names = ("ph", "pd", "pa")
    other = right.select(*key, *[F.col(p).alias(f"_{p}") for p in names])
    differs = F.lit(False)
    for p in names:
        differs = differs | (F.abs(F.col(p) - F.col(f"_{p}")) > tolerance)
    return left.select(*key, *names).join(other, list(key)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("n_changed")
    )
