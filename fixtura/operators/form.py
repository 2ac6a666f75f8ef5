"""As-of features of a contest history: rolling form, goal trend, head-to-head.

Every weight is ``max(0.5^(lag/half_life), floor) * importance`` over contests
strictly before the probe day. A contest therefore enters the history the day
after it is played, stops halving once the floor binds, and leaves when the
window ends. Writing those three moments as signed rows turns all look-backs
into one running sum per key, whose groups hold at most a few rows per day.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Powers of two of all days fit into a double for half-lives from this on; below, the timeline is cut and each cut has its
# own day 0. Half-lives that a cut holds at least:
PLAIN_HALF_LIFE = 30.0
CUT_HALF_LIVES = 400


def side_rows(contests: DataFrame, *keep: str) -> DataFrame:
    """Two rows per contest, one seen from each side, from a single scan."""

    def side(own: str, other: str, home: bool) -> Column:
        return F.struct(
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.col(f"{own}_score").alias("scored"),
            F.col(f"{other}_score").alias("conceded"),
            F.lit(home).alias("is_home"),
        )

    return contests.select(
        "day", *keep, F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("_s")
    ).select("day", *keep, "_s.*")


def outcome(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 1.0).when(scored == conceded, 0.5).when(scored < conceded, 0.0)


def team_day_partials(contests: DataFrame, importance: Column) -> DataFrame:
    """Per (team, day): contests, importance, and importance-weighted outcome and goals."""
    rows = side_rows(contests.withColumn("_w", importance), "_w")
    w = F.col("_w")
    return rows.groupBy("team", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        F.sum(w * outcome(F.col("scored"), F.col("conceded"))).alias("w_outcome"),
        F.sum(w * F.col("scored")).alias("w_scored"),
        F.sum(w * F.col("conceded")).alias("w_conceded"),
    )


def pair_day_partials(contests: DataFrame, importance: Column) -> DataFrame:
    """Per (unordered pair, day), outcome seen from the side whose name sorts first."""
    lo = F.least("home_team", "away_team")
    home_view = outcome(F.col("home_score"), F.col("away_score"))
    return (
        contests.select(
            lo.alias("lo"),
            F.greatest("home_team", "away_team").alias("hi"),
            "day",
            importance.alias("_w"),
            F.when(F.col("home_team") == lo, home_view).otherwise(1.0 - home_view).alias("_x"),
        )
        .groupBy("lo", "hi", "day")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_w").alias("w"),
            F.sum(F.col("_w") * F.col("_x")).alias("w_outcome"),
        )
    )


def decayed_totals(
    partials: DataFrame,
    keys: list[str],
    measures: list[str],
    half_life: float,
    floor: float,
    window: int | None = None,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Decayed sums of additive measures at each probe (keys, day), history strictly before it.

    ``partials`` holds (keys, day, n, measures); ``window`` counts days back,
    inclusive. Probes default to the days of ``partials``, taken from the same
    scan. A probe without history gets NULL measures and ``n`` = 0.
    """
    bind = math.floor(half_life * math.log2(1.0 / floor)) if floor > 0 else None
    if window is not None and (bind is None or window <= bind):
        bind = None
    day = F.col("day")
    reach = bind if bind is not None else window
    span = None if half_life >= PLAIN_HALF_LIFE else max(math.ceil(CUT_HALF_LIVES * half_life), (reach or 0) + 1)

    def cut_of(at: Column) -> Column:
        return F.floor(at / span).cast("int") if span else F.lit(0)

    def growth(days: Column, cut: Column) -> Column:
        return F.pow(F.lit(2.0), (days - cut * (span or 0)) / F.lit(half_life))

    def moment(after: int, live: int, flat: int, asks: bool = False, carried: bool = False) -> Column:
        """What changes ``after`` days on. ``carried`` puts a live sum, without its count, at the start of the cut it ends in."""
        at = day + after
        cut = cut_of(at)
        return F.struct(
            F.lit(asks).alias("is_probe"),
            (cut * (span or 0) if carried else at).cast("int").alias("day"),
            cut.alias("cut"),
            (F.col("n") * (0 if carried else live)).alias("live_n"),
            (F.col("n") * flat).alias("flat_n"),
            *[(F.col(m) * growth(day, cut) * live).alias(f"live_{m}") for m in measures],
            *[(F.col(m) * float(flat)).alias(f"flat_{m}") for m in measures],
        )

    moments = [moment(1, 1, 0)]
    if span:
        # What is still live when its cut ends goes on in the next one; without an end it counts for one more cut.
        last = (reach or span - 1) + 1
        moments.append(F.when(cut_of(day + 1) < cut_of(day + last), moment(last, 1, 0, carried=True)))
    if bind is not None:
        moments.append(moment(bind + 1, -1, 1))
    if window is not None:
        moments.append(moment(window + 1, 0, -1) if bind is not None else moment(window + 1, -1, 0))
    if probes is None:
        moments.append(moment(0, 0, 0, asks=True))
    rows = partials.select(*keys, F.explode(F.array(*moments)).alias("_m")).where("_m IS NOT NULL").select(*keys, "_m.*")
    sums = [c for c in rows.columns if c.startswith(("live_", "flat_"))]
    if probes is not None:
        asked = probes.select(*keys, "day", cut_of(day).alias("cut"), F.lit(True).alias("is_probe"))
        rows = rows.unionByName(asked, allowMissingColumns=True)
    so_far = W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    in_cut = W.partitionBy(*keys, "cut").orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow) if span else so_far
    decaying = {f"live_{m}" for m in measures}
    running = rows.select(
        *keys, "day", "cut", "is_probe", *[F.sum(c).over(in_cut if c in decaying else so_far).alias(c) for c in sums]
    )
    shrink = 1.0 / growth(day, F.col("cut"))

    def total(m: str) -> Column:
        live = F.when(F.col("live_n") > 0, shrink * F.col(f"live_{m}")).otherwise(0.0)
        flat = F.when(F.col("flat_n") > 0, floor * F.col(f"flat_{m}")).otherwise(0.0)
        return F.when(F.col("live_n") + F.col("flat_n") > 0, live + flat).alias(m)

    return running.filter("is_probe").select(
        *keys, "day", (F.col("live_n") + F.col("flat_n")).alias("n"), *[total(m) for m in measures]
    )


def team_form(
    contests: DataFrame,
    importance: Column,
    half_life: float = 730.0,
    floor: float = 0.05,
    window_years: int = 10,
    probes: DataFrame | None = None,
) -> DataFrame:
    """(team, day) -> form, goals_scored, goals_conceded, goal_differential.

    Probes default to every day a team plays; a year counts 365 days.
    """
    partials = team_day_partials(contests, importance)
    totals = decayed_totals(
        partials, ["team"], ["w", "w_outcome", "w_scored", "w_conceded"], half_life, floor, 365 * window_years, probes
    )
    scored, conceded = F.col("w_scored") / F.col("w"), F.col("w_conceded") / F.col("w")
    return totals.select(
        "team",
        "day",
        (F.col("w_outcome") / F.col("w")).alias("form"),
        scored.alias("goals_scored"),
        conceded.alias("goals_conceded"),
        (scored - conceded).alias("goal_differential"),
    )


def pair_record(
    contests: DataFrame,
    importance: Column,
    half_life: float = 3650.0,
    floor: float = 0.05,
    probes: DataFrame | None = None,
) -> DataFrame:
    """(lo, hi, day) -> weighted win share of ``lo`` over all earlier meetings."""
    partials = pair_day_partials(contests, importance)
    totals = decayed_totals(partials, ["lo", "hi"], ["w", "w_outcome"], half_life, floor, probes=probes)
    return totals.select("lo", "hi", "day", (F.col("w_outcome") / F.col("w")).alias("lo_share"))


def team_names(contests: DataFrame) -> DataFrame:
    """Distinct names over both sides."""
    return contests.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def matches_per_team(contests: DataFrame) -> DataFrame:
    return side_rows(contests).groupBy("team").agg(F.count(F.lit(1)).alias("n_matches"))


def latest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Most recent ``n`` rows of a finished result; look-back features are computed before this."""
    return df.orderBy(*order).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
