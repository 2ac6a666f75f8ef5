"""Contest cleaning and team renames over validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.runtime import SMALL_SIDE_ROWS

# Contests of non-member bodies are left out of the history.
NON_MEMBER_TOURNAMENTS = (
    "CONIFA Africa Football Cup", "CONIFA Asia Cup", "CONIFA European Football Cup",
    "CONIFA South America Football Cup", "CONIFA World Cup qualification",
    "CONIFA World Football Cup", "CONIFA World Football Cup qualification",
    "ConIFA Challenger Cup", "Viva World Cup",
)
FIRST_YEAR = 1990


def current_names(contests: DataFrame, renames: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Replace both sides' names by the name current for a former one valid on the match date.

    ``renames`` is (row_no, former, current, start_date, end_date), both dates
    inclusive; the lowest ``row_no`` wins. Each (name, date) is resolved once, so a
    team with many contests costs one lookup per day rather than one per row.
    """
    dates = contests.select(
        "match_date", F.explode(F.array("home_team", "away_team")).alias("former")
    ).distinct()
    small = renames.count() <= max_rows
    spans = F.broadcast(renames) if small else renames
    resolved = (
        dates.join(spans, "former")
        .filter(F.col("match_date").between(F.col("start_date"), F.col("end_date")))
        .groupBy("former", "match_date")
        .agg(F.min_by("current", "row_no").alias("current"))
    )
    out = contests
    for side in ("home_team", "away_team"):
        lookup = resolved.select(
            "match_date", F.col("former").alias(side), F.col("current").alias(f"_{side}")
        )
        out = out.join(lookup, ["match_date", side], "left").withColumn(
            side, F.coalesce(f"_{side}", side)
        ).drop(f"_{side}")
    return out.select(*contests.columns)


def clean_contests(
    raw: DataFrame,
    renames: DataFrame,
    first_year: int = FIRST_YEAR,
    excluded: Sequence[str] = NON_MEMBER_TOURNAMENTS,
) -> DataFrame:
    """Drop early, unplayed and non-member contests and apply renames to the rest."""
    kept = (
        raw.filter(F.year("match_date") >= first_year)
        .dropna(subset=["home_score", "away_score"])
        .filter(~F.col("tournament").isin(*excluded) | F.col("tournament").isNull())
    )
    return current_names(kept, renames)
