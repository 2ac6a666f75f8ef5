"""Forecast scores. A forecast is (ph, pd, pa) for the classes H, D, A."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.functions.labels import CLASSES, probability_of, top_class

CLIP = 1e-15
P = ("ph", "pd", "pa")


def log_loss(label: Column, ph: Column, pd: Column, pa: Column) -> Column:
    return -F.log(F.greatest(probability_of(label, ph, pd, pa), F.lit(CLIP)))


def brier(label: Column, ph: Column, pd: Column, pa: Column) -> Column:
    def miss(p: Column, name: str) -> Column:
        return F.pow(p - (label == name).cast("double"), F.lit(2.0))

    return miss(ph, "H") + miss(pd, "D") + miss(pa, "A")


def hit(label: Column, prediction: Column) -> Column:
    return F.when(prediction.isNotNull(), (label == prediction).cast("double"))


def long_forecasts(df: DataFrame, models: Mapping[str, Sequence[Column]], keep: Sequence[str]) -> DataFrame:
    """One row per (row, model) from one scan; ``models`` maps a name to its (ph, pd, pa)."""
    parts = [
        F.struct(F.lit(name).alias("model"), *[c.cast("double").alias(p) for c, p in zip(triple, P)])
        for name, triple in models.items()
    ]
    return df.select(*keep, F.explode(F.array(*parts)).alias("_f")).select(*keep, "_f.*")


def pooled(forecasts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """n, accuracy, log-loss and Brier per group; ``forecasts`` has result, ph, pd, pa."""
    label, triple = F.col("result"), [F.col(p) for p in P]
    return forecasts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit(label, top_class(*triple))).alias("accuracy"),
        F.avg(log_loss(label, *triple)).alias("log_loss"),
        F.avg(brier(label, *triple)).alias("brier"),
    )


def base_rates(df: DataFrame) -> DataFrame:
    """Class shares of a block in H, D, A order, as one row."""
    return df.agg(*[F.avg((F.col("result") == c).cast("double")).alias(f"base_{p}") for c, p in zip(CLASSES, P)])


def recall_and_mix(df: DataFrame, prediction: Column) -> DataFrame:
    """Per class: recall (0 when the class never occurs) and share of predictions."""
    scored = df.select("result", prediction.alias("pick"))
    parts = []
    for c in CLASSES:
        truth, picked = F.col("result") == c, F.col("pick") == c
        parts.append(
            F.struct(
                F.lit(c).alias("class"),
                F.coalesce(
                    F.try_divide(F.count_if(truth & picked).cast("double"), F.count_if(truth).cast("double")), F.lit(0.0)
                ).alias("recall"),
                (F.count_if(picked) / F.count(F.lit(1))).alias("picked_share"),
            )
        )
    return scored.agg(F.array(*parts).alias("_c")).select(F.inline("_c"))


def covered(df: DataFrame, columns: Sequence[str] = ("book_ph", "book_pd", "book_pa")) -> DataFrame:
    return df.dropna(subset=list(columns))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], slices: int = 1024) -> list[float]:
    """Exact linearly interpolated quantiles of a column of probabilities.

    Equal values collapse to a count, values are ranked inside slices of [0, 1], and
    slice totals give each slice its first rank; only the asked values reach the driver.
    """
    counts = (
        df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).groupBy("v")
        .agg(F.count(F.lit(1)).alias("c")).withColumn("_slice", F.floor(F.col("v") * slices))
    )
    totals = counts.groupBy("_slice").agg(F.sum("c").alias("_total"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    n = totals.agg(F.sum("_total")).first()[0]
    if not n:
        return []
    places = [q * (n - 1) for q in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    upto = W.partitionBy("_slice").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        counts.withColumn("_end", F.sum("c").over(upto))
        .join(starts, "_slice")
        .select("v", (F.col("_start") + F.col("_end") - F.col("c")).alias("lo"), (F.col("_start") + F.col("_end")).alias("hi"))
    )
    hits = ranked.select(
        "v", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda r: (r >= F.col("lo")) & (r < F.col("hi")))).alias("r")
    )
    value = {row["r"]: row["v"] for row in hits.collect()}
    return [
        value[int(p)] + (p - int(p)) * (value[min(int(p) + 1, n - 1)] - value[int(p)]) for p in places
    ]


def reliability(df: DataFrame, probability: str = "ph", label: str = "H", bins: int = 10) -> DataFrame:
    """Quantile bins of a class probability: mean predicted, share that happened, gap."""
    edges = quantiles(df, probability, [i / bins for i in range(1, bins)])
    p = F.col(probability)
    bin_no = sum(((p > e).cast("int") for e in edges), F.lit(0))
    return (
        df.filter(p.isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("predicted"),
            F.avg((F.col("result") == label).cast("double")).alias("actual"),
        )
        .withColumn("gap", F.abs(F.col("predicted") - F.col("actual")))
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Bin-share weighted mean gap."""
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def calibration_error_equal_width(df: DataFrame, reliability_bins: DataFrame, probability: str = "ph", bins: int = 10) -> float:
    """The published variant: quantile-bin gaps weighted by equal-width bin shares, by position."""
    p = F.col(probability)
    lo, hi, n = df.agg(F.min(p), F.max(p), F.count(p)).first()
    edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    shares = df.agg(*[F.avg(p.between(a, b).cast("double")) for a, b in zip(edges, edges[1:])]).first()
    gaps = [r["gap"] for r in reliability_bins.orderBy("bin").collect()]
    return sum(w * g for w, g in zip(shares, gaps))


def upset_report(df: DataFrame, favourite: Column) -> DataFrame:
    """How often the favourite failed and the mean probability given to what happened."""
    p = probability_of(F.col("result"), *[F.col(c) for c in P])
    upset = F.col("result") != favourite
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(upset.cast("double")).alias("upset_share"),
        F.avg(F.when(upset, p)).alias("p_actual_upset"),
        F.avg(F.when(~upset, p)).alias("p_actual_other"),
    )


def evaluate(df: DataFrame, favourite: Column, base: Sequence[float], slices: Mapping[str, Column]) -> DataFrame:
    """Model, form favourite, always-home and base rates side by side per slice.

    Label-only predictors get accuracy; the base rates get log-loss and Brier.
    """
    label = F.col("result")
    triple = [F.col(p) for p in P]
    flat = [F.lit(float(b)) for b in base]
    nothing = F.lit(None).cast("double")
    rows = [
        ("model", hit(label, top_class(*triple)), log_loss(label, *triple), brier(label, *triple)),
        ("form_favourite", hit(label, favourite), nothing, nothing),
        ("always_home", hit(label, F.lit("H")), nothing, nothing),
        ("base_rate", nothing, log_loss(label, *flat), brier(label, *flat)),
    ]
    lines = [
        F.struct(
            F.lit(part).alias("slice"),
            F.lit(name).alias("predictor"),
            F.count_if(inside).alias("n"),
            *[F.avg(F.when(inside, value)).alias(score) for score, value in zip(("accuracy", "log_loss", "brier"), values)],
        )
        for part, inside in slices.items()
        for name, *values in rows
    ]
    # One running row of sums instead of a row per contest, slice and predictor; a slice without rows has no line.
    return df.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines")).filter(F.col("n") > 0)
