"""Roster profiles and snapshot ratings per team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.functions.labels import EDITION_SNAPSHOT, EDITION_START
from fixtura.runtime import shuffled, sized_broadcast

POSITIONS = ("GK", "DF", "MF", "FW")
MIN_RATED = 11


def appearances(players: DataFrame, squads: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Star join: one row per player and edition with team and edition names."""
    return (
        players.join(sized_broadcast(squads), "squad_id")
        .join(sized_broadcast(tournaments), "tournament_id")
        .withColumnsRenamed({"country": "team", "name": "edition"})
    )


def age_depth(roster: DataFrame) -> DataFrame:
    """(team, edition) -> mean age, squad size, count and share per position."""
    size = F.col("squad_size")
    counted = roster.groupBy("team", "edition").agg(
        F.avg("age").alias("mean_age"),
        F.count(F.lit(1)).alias("squad_size"),
        *[F.count_if(F.col("position") == p).alias(f"n_{p.lower()}") for p in POSITIONS],
    )
    return counted.select(
        "*", *[(F.col(f"n_{p.lower()}") / size).alias(f"share_{p.lower()}") for p in POSITIONS]
    )


def club_concentration(roster: DataFrame) -> DataFrame:
    """(team, edition) -> largest club, two largest, HHI, same-club pairs and their share.

    The squad size counts every player; club counts skip unknown clubs.
    """
    clubs = roster.groupBy("team", "edition", "club").agg(F.count(F.lit(1)).alias("all_rows"))
    known = F.when(F.col("club").isNotNull(), F.col("all_rows"))
    by_size = W.partitionBy("team", "edition").orderBy(F.col("c").desc_nulls_last(), F.col("club"))
    ranked = clubs.withColumn("c", known).withColumn("place", F.row_number().over(by_size))
    c, n = F.col("c"), F.sum("all_rows")
    per_squad = ranked.groupBy("team", "edition").agg(
        n.alias("squad_size"),
        F.coalesce(F.max("c"), F.lit(0)).alias("largest_club_bloc"),
        F.coalesce(F.sum(F.when(F.col("place") <= 2, c)), F.lit(0)).alias("top2_club_bloc"),
        (F.sum(c * c) / (n * n)).alias("club_hhi"),
        F.coalesce(F.sum(F.floor(c * (c - 1) / 2)), F.lit(0)).alias("same_club_pairs"),
        F.count("c").alias("n_distinct_clubs"),
    )
    pairs = F.col("squad_size") * (F.col("squad_size") - 1) / 2
    return per_squad.withColumn("same_club_pair_ratio", F.col("same_club_pairs") / F.nullif(pairs, F.lit(0.0)))


def era_ratings(roster: DataFrame, ratings: DataFrame, snapshots: dict[str, int] = EDITION_SNAPSHOT) -> DataFrame:
    """Left-join each appearance to its player's rating at the edition's own snapshot."""
    version = F.lit(None).cast("int")
    for edition, number in snapshots.items():
        version = F.when(F.col("edition") == edition, number).otherwise(version)
    tagged = roster.withColumn("version", version).filter(F.col("version").isNotNull())
    return tagged.join(shuffled(ratings), ["player_id", "version"], "left")


def mean_rating(rated: DataFrame, min_rated: int = MIN_RATED) -> DataFrame:
    """(team, edition) -> mean overall and potential, NULL below ``min_rated`` rated players."""
    enough = F.col("n_rated") >= min_rated
    return (
        rated.groupBy("team", "edition")
        .agg(
            F.count("overall").alias("n_rated"),
            F.avg("overall").alias("_overall"),
            F.avg("potential").alias("_potential"),
        )
        .select(
            "team",
            "edition",
            F.when(enough, F.col("_overall")).alias("mean_overall"),
            F.when(enough, F.col("_potential")).alias("mean_potential"),
            "n_rated",
        )
    )


def first_seen(roster: DataFrame, seen: Column) -> DataFrame:
    """(team, player) -> first date the player appeared for the team."""
    return roster.groupBy("team", "player_id").agg(F.min(seen).alias("first_seen"))


def edition_start(starts: dict[str, str] = EDITION_START) -> Column:
    start = F.lit(None).cast("date")
    for edition, date in starts.items():
        start = F.when(F.col("edition") == edition, F.to_date(F.lit(date))).otherwise(start)
    return start


def team_pool(seen: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every snapshot rating of each known player, with the date the team first fielded them."""
    return seen.join(shuffled(ratings.select("player_id", "version", "overall")), "player_id")


def pool_rating(pool: DataFrame, probes: DataFrame, version: Column, min_rated: int = MIN_RATED) -> DataFrame:
    """(team, match_date) -> mean overall of the players known by that date.

    The pool is summed per (team, version, first day) before it meets the probes,
    so the running sum over days sees at most one pool row per day.
    """
    additions = pool.groupBy("team", "version", F.col("first_seen").alias("match_date")).agg(
        F.sum(F.col("overall").cast("bigint")).alias("total"), F.count("overall").alias("known")
    )
    asked = probes.select("team", "match_date").distinct().withColumn("version", version)
    rows = additions.withColumn("is_probe", F.lit(False)).unionByName(
        asked.filter(F.col("version").isNotNull()).withColumn("is_probe", F.lit(True)), allowMissingColumns=True
    )
    so_far = (
        W.partitionBy("team", "version").orderBy("match_date").rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    known = F.coalesce(F.sum("known").over(so_far), F.lit(0))
    return (
        rows.select("team", "match_date", "is_probe", known.alias("n_rated"), F.sum("total").over(so_far).alias("_total"))
        .filter("is_probe")
        .select(
            "team",
            "match_date",
            "n_rated",
            F.when(F.col("n_rated") >= min_rated, F.col("_total") / F.col("n_rated")).alias("pool_rating"),
        )
    )
