"""Result labels, edition rules and simple forecasts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.runtime import sized_broadcast

CLASSES = ("H", "D", "A")

# Contest labels that own roster editions, the postponed edition,
# the rating snapshots held, and when each covered edition began.
EDITION_COMPETITIONS = {"FIFA World Cup": "World Cup", "UEFA Euro": "Euro"}
POSTPONED_EDITIONS = {("Euro", 2021): 2020}
FIRST_SNAPSHOT, LAST_SNAPSHOT, SNAPSHOT_MONTH = 15, 24, 9
EDITION_SNAPSHOT = {
    "Euro 2016": 16, "World Cup 2018": 18, "Euro 2020": 21, "World Cup 2022": 23, "Euro 2024": 24,
}
EDITION_START = {
    "Euro 2016": "2016-06-10", "World Cup 2018": "2018-06-14", "Euro 2020": "2021-06-11",
    "World Cup 2022": "2022-11-20", "Euro 2024": "2024-06-14",
}


def result(home_score: Column, away_score: Column) -> Column:
    return (
        F.when(home_score > away_score, F.lit("H"))
        .when(home_score == away_score, F.lit("D"))
        .when(home_score < away_score, F.lit("A"))
    )


def label_code(label: Column) -> Column:
    return F.when(label == "H", 0).when(label == "D", 1).when(label == "A", 2)


def code_label(code: Column) -> Column:
    return F.when(code == 0, "H").when(code == 1, "D").when(code == 2, "A")


def snapshot_for_date(
    date: Column, base_year: int = 2000, first: int = FIRST_SNAPSHOT, last: int = LAST_SNAPSHOT
) -> Column:
    """Newest rating snapshot released by ``date``: a year's snapshot ships in September.

    NULL before the first snapshot; later dates stay on the last one held.
    """
    version = F.year(date) - base_year + (F.month(date) >= SNAPSHOT_MONTH).cast("int")
    return F.when(version >= first, F.least(version, F.lit(last)))


def with_edition(
    contests: DataFrame,
    editions: DataFrame,
    competitions: dict[str, str] = EDITION_COMPETITIONS,
    postponed: dict[tuple[str, int], int] = POSTPONED_EDITIONS,
) -> DataFrame:
    """Left-join the edition name of (competition, year); no edition leaves NULL.

    ``editions`` is (competition, year, name).
    """
    competition = F.lit(None).cast("string")
    for label, name in competitions.items():
        competition = F.when(F.col("tournament") == label, F.lit(name)).otherwise(competition)
    year = F.year("match_date")
    for (name, played), official in postponed.items():
        year = F.when((F.col("_competition") == name) & (F.year("match_date") == played), official).otherwise(year)
    keyed = contests.withColumn("_competition", competition).withColumn("_year", year)
    lookup = sized_broadcast(
        editions.select(
            F.col("competition").alias("_competition"), F.col("year").alias("_year"), F.col("name").alias("edition")
        )
    )
    return keyed.join(lookup, ["_competition", "_year"], "left").drop("_competition", "_year")


def form_favourite(home_form: Column, away_form: Column) -> Column:
    """Away only when its form is strictly higher; ties and unknown form go to home."""
    return F.when(away_form > home_form, F.lit("A")).otherwise(F.lit("H"))


def top_class(ph: Column, pd: Column, pa: Column) -> Column:
    """First maximum in H, D, A order."""
    return (
        F.when((ph >= pd) & (ph >= pa), F.lit("H"))
        .when((pd >= pa) & ph.isNotNull(), F.lit("D"))
        .when(pa.isNotNull(), F.lit("A"))
    )


def probability_of(label: Column, ph: Column, pd: Column, pa: Column) -> Column:
    return F.when(label == "H", ph).when(label == "D", pd).when(label == "A", pa)
