"""Training matrix: every contest with the features known before it was played."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.labels import result
from fixtura.operators.form import pair_record, side_rows, team_form
from fixtura.operators.squads import age_depth, club_concentration, pool_rating
from fixtura.runtime import sized_broadcast, written

# Feature and metadata names and their order, shared with every reader of a stored matrix.
BASE_FEATURES = [
    "neutral", "importance", "home_form", "away_form",
    "home_gs", "home_gc", "away_gs", "away_gc", "h2h",
]
SQUAD_FEATURES = [
    "home_mean_age", "away_mean_age",
    "home_squad_size", "away_squad_size",
    "home_club_hhi", "away_club_hhi",
    "home_same_club_pair_ratio", "away_same_club_pair_ratio",
    "home_largest_club_bloc", "away_largest_club_bloc",
]
RATING_FEATURES = ["rating_gap"]
FEATURES = BASE_FEATURES + SQUAD_FEATURES + RATING_FEATURES
# Fixed values, as above.
METADATA = [
    "match_date", "home_team", "away_team", "tournament", "edition",
    "home_pool_rating", "away_pool_rating", "home_score", "away_score",
    "book_ph", "book_pd", "book_pa",
]
LABEL = "result"
FEATURE_SETS = {
    "base": BASE_FEATURES,
    "base+squad": BASE_FEATURES + SQUAD_FEATURES,
    "base+rating": BASE_FEATURES + RATING_FEATURES,
    "full": FEATURES,
}
# What a contest's features follow from, apart from its own columns.
FIXTURE = ["match_date", "day", "home_team", "away_team", "edition"]
SQUAD_FIELDS = ["mean_age", "squad_size", "club_hhi", "same_club_pair_ratio", "largest_club_bloc"]


def squad_profiles(roster: DataFrame) -> DataFrame:
    """The five squad scalars of each (team, edition); a team without a squad has no row."""
    return (
        age_depth(roster).select("team", "edition", "mean_age", "squad_size")
        .join(club_concentration(roster).drop("squad_size"), ["team", "edition"])
        .select("team", "edition", *SQUAD_FIELDS)
    )


def build_matrix(
    contests: DataFrame,
    importance: Column,
    roster: DataFrame,
    pool: DataFrame,
    version: Column,
    quotes: DataFrame,
    half_life: float = 730.0,
    window_years: int = 10,
    pair_half_life: float = 3650.0,
    min_rated: int = 11,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Metadata, features and label per contest.

    ``contests`` carries ``edition`` (NULL where none) and is read several times: pass a stored table. Columns named by
    ``keep`` go along. Form and pool ratings are worked out once per (team, day). They, squad profiles, pair records and quotes
    are joined to distinct fixtures, as plain lookups, so an absent squad or quote leaves NULLs; contests move once, without
    features, and meet their fixture's row.
    """
    team_days = (
        side_rows(contests).select("team", "day").distinct()
        .withColumn("match_date", F.date_from_unix_date("day"))
    )
    pools = pool_rating(pool, team_days, version, min_rated).select(
        "team", F.unix_date("match_date").alias("day"), "pool_rating"
    )
    by_day = sized_broadcast(
        written(team_form(contests, importance, half_life, window_years=window_years).join(pools, ["team", "day"], "left"))
    )
    squads = sized_broadcast(squad_profiles(roster))
    pairs = pair_record(contests, importance, pair_half_life)

    def day_side(side: str) -> DataFrame:
        return by_day.select(
            F.col("team").alias(f"{side}_team"),
            "day",
            F.col("form").alias(f"{side}_form"),
            F.col("goals_scored").alias(f"{side}_gs"),
            F.col("goals_conceded").alias(f"{side}_gc"),
            F.col("pool_rating").alias(f"{side}_pool_rating"),
        )

    def squad_side(side: str) -> DataFrame:
        return squads.select(
            F.col("team").alias(f"{side}_team"), "edition", *[F.col(f).alias(f"{side}_{f}") for f in SQUAD_FIELDS]
        )

    facts = contests.select(*FIXTURE).distinct().withColumns(
        {"lo": F.least("home_team", "away_team"), "hi": F.greatest("home_team", "away_team")}
    )
    for side in ("home", "away"):
        facts = facts.join(day_side(side), [f"{side}_team", "day"], "left")
        facts = facts.join(squad_side(side), [f"{side}_team", "edition"], "left")
    facts = facts.join(pairs, ["lo", "hi", "day"], "left").join(quotes, ["match_date", "home_team", "away_team"], "left")
    facts = facts.withColumns(
        {
            "h2h": F.when(F.col("home_team") == F.col("lo"), F.col("lo_share")).otherwise(1.0 - F.col("lo_share")),
            "rating_gap": F.col("home_pool_rating") - F.col("away_pool_rating"),
        }
    ).withColumnsRenamed({c: f"_{c}" for c in FIXTURE})
    facts = sized_broadcast(written(facts.drop("lo", "hi", "lo_share")))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIXTURE])
    return contests.join(facts, same, "left").withColumns(
        {
            "importance": importance,
            "neutral": F.col("neutral").cast("int"),
            LABEL: result(F.col("home_score"), F.col("away_score")),
        }
    ).select(*METADATA, *FEATURES, LABEL, *keep)


def matrix_health(matrix: DataFrame) -> DataFrame:
    """Rows, label shares and NULL count per feature, in one pass."""
    return matrix.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg((F.col(LABEL) == c).cast("double")).alias(f"share_{c.lower()}") for c in ("H", "D", "A")],
        *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in FEATURES],
    )


def temporal_split(matrix: DataFrame, valid_start: str = "2014-01-01", test_start: str = "2016-01-01") -> DataFrame:
    """Tag rows train, valid or test by date."""
    date = F.col("match_date")
    return matrix.withColumn(
        "part",
        F.when(date < F.to_date(F.lit(valid_start)), "train")
        .when(date < F.to_date(F.lit(test_start)), "valid")
        .when(date.isNotNull(), "test"),
    )


def widest_form_gap(matrix: DataFrame) -> DataFrame:
    """The contest with the largest home form lead."""
    gap = F.col("home_form") - F.col("away_form")
    row = F.struct("match_date", "home_team", "away_team", "home_form", "away_form", LABEL)
    order = F.struct(gap.alias("gap"), (-F.unix_date("match_date")).alias("early"), "home_team", "away_team", LABEL)
    return matrix.filter(gap.isNotNull()).agg(F.max_by(row, order).alias("_r")).select("_r.*")
