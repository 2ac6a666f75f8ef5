"""Mixing of quote sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.runtime import sized_broadcast

# A Poisson draw is the sum of independent draws with means of at most this, so no table of
# cumulative probabilities is longer than STEPS however large a rate is.
PART = 16.0
# P(X > STEPS) for a mean of PART is below 1e-25, less than the spacing of the uniforms.
STEPS = 80


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the seed and the parts (NULL as empty text)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0..STEPS, X Poisson with ``mean`` <= PART."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), start,
        lambda a, k: F.struct(
            (a.p * mean / k).alias("p"), (a.c + a.p * mean / k).alias("c"),
            F.concat(a["all"], F.array(a.c + a.p * mean / k)).alias("all"),
        ),
        lambda a: a["all"],
    )


def rates(quotes: DataFrame, targets: DataFrame, rows: int | None = None) -> DataFrame:
    """Mean repetitions per source: weight share x rows / rows of the source.

    ``targets`` has ``source`` (NULL is a source of its own) and ``weight`` >= 0; repeated sources add up. A source
    without a target, or with a NULL or negative weight, has rate 0. Targets without rows are left out and the other
    shares grow accordingly. ``rows`` is the wanted size of the mixture, by default that of the input.
    """
    have = quotes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    want = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
    both = have.alias("h").join(want.alias("w"), F.expr("h.source <=> w.source"), "left").select(
        "h.source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    total = both.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("all_rows"))
    wanted = F.lit(rows).cast("double") if rows is not None else F.col("all_rows").cast("double")
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    # One row joins one row per source.
    return both.join(F.broadcast(total)).select("source", "n_rows", (share * wanted / F.col("n_rows")).alias("rate"))


def repetitions(key: Column, rate: Column, table: Column, rest: Column, seed: int) -> Column:
    """Poisson count of a record: whole parts of mean PART by ``table`` and one part of the remainder by ``rest``.

    ``table`` and ``rest`` are the cumulative probabilities; a uniform falls behind as many of them as the count.
    """
    def inverse(table: Column, u: Column) -> Column:
        return F.size(F.filter(table, lambda c: c <= u))

    whole = F.floor(rate / PART).cast("int")
    parts = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    many = F.aggregate(parts, F.lit(0), lambda a, j: a + inverse(table, uniform(seed, key, j)))
    return many + inverse(rest, uniform(seed, key, F.lit(0)))


def replicate(records: DataFrame, key: str, source: str, targets: DataFrame, seed: int, rows: int | None = None,
              copy: str | None = "copy") -> DataFrame:
    """Every record of ``records`` repeated by its Poisson count, in an order drawn by hash.

    Rates come from ``rates``, one row per source; while they are few enough to be broadcast no record moves to meet them. The draw depends on the
    seed, the key and nothing else, so a retried task repeats it. ``copy`` numbers repetitions from 1; it replaces a column
    of that name, and None leaves it out. Rows are dealt to partitions by a hash of (key, copy) and sorted by it
    there: one shuffle on a uniform key, whatever source is hot. Repeated rows draw alike; a NULL key counts as empty text.
    """
    means = rates(records.select(F.col(f"`{source}`").alias("source")), targets, rows).where("rate > 0").select(
        "source", "rate", cumulative(F.lit(PART)).alias("table"), cumulative(F.col("rate") - F.floor(F.col("rate") / PART) * PART).alias("rest")
    )
    # The record travels as one column, so no name of its own can clash.
    record = records.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"))
    drawn = record.join(sized_broadcast(means), F.col("s").eqNullSafe(F.col("source"))).withColumn(
        "n", repetitions(F.col("k"), F.col("rate"), F.col("table"), F.col("rest"), seed)
    ).where("n > 0")
    copies = drawn.select("k", "record", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    mixed = copies.withColumn("order", F.xxhash64(F.lit(seed), F.col("k").cast("string"), "i")).repartition("order").sortWithinPartitions("order")
    own = [F.col(f"record.`{c}`") for c in records.columns if c != copy]
    return mixed.select(*own, *([F.col("i").alias(copy)] if copy else []))


def mix_quotes(quotes: DataFrame, targets: DataFrame, seed: int = 7, rows: int | None = None) -> DataFrame:
    """Match-odds records (``odds_id``, ``source`` and any further fields) mixed to target weights of their sources.

    ``targets``: ``source``, ``weight``. Adds ``copy``; see ``replicate`` and ``rates``.
    """
    return replicate(quotes, "odds_id", "source", targets, seed, rows)


def tempered_targets(quotes: DataFrame, exponent: float) -> DataFrame:
    """Targets proportional to (rows of the source) ** exponent: 1 keeps the mixture, 0 makes sources equal."""
    counted = quotes.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("source", F.pow(F.col("n").cast("double"), F.lit(float(exponent))).alias("weight"))
