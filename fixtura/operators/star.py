"""Flat rosters to a star of tournaments, squads and players."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.functions.names import age_at_event, birth_date, is_captain, player_name, safe_int
from fixtura.operators.ordered import number_rows
from fixtura.runtime import sized_broadcast


class Star(NamedTuple):
    tournaments: DataFrame
    squads: DataFrame
    players: DataFrame
    skipped: DataFrame


def normalise_rosters(flat: DataFrame, tournaments: DataFrame) -> Star:
    """Assign surrogate keys and split the flat table; rows without a name are counted, not kept.

    ``flat`` carries row_no and the columns No., Pos., Player, Date of birth (age),
    Caps, Goals, Club, country, tournament. Keys follow (tournament, country) order
    and, for players, squad then ``row_no``.
    """
    pairs = flat.select("tournament", "country").distinct().withColumn("_all", F.lit(0))
    numbered = number_rows(pairs, "_all", "tournament", "country").select(
        (F.col("ordinal") + 1).alias("squad_id"), F.col("tournament").alias("name"), "country"
    )
    keyed = numbered.join(sized_broadcast(tournaments.select("tournament_id", "name")), "name")
    squads = keyed.select("squad_id", "tournament_id", "country")
    named = flat.withColumn("player_name", player_name(F.col("Player")))
    rows = (
        named.filter(F.col("player_name").isNotNull())
        .join(
            keyed.select("squad_id", "country", F.col("name").alias("tournament")), ["tournament", "country"]
        )
        .withColumn("_all", F.lit(0))
    )
    born = F.col("`Date of birth (age)`")
    players = number_rows(rows, "_all", "squad_id", "row_no").select(
        (F.col("ordinal") + 1).alias("player_appearance_id"),
        "squad_id",
        safe_int(F.col("`No.`")).alias("squad_number"),
        F.col("`Pos.`").alias("position"),
        "player_name",
        is_captain(F.col("Player")).alias("is_captain"),
        birth_date(born).alias("date_of_birth"),
        age_at_event(born).alias("age_at_tournament"),
        safe_int(F.col("Caps")).alias("caps"),
        safe_int(F.col("Goals")).alias("goals"),
        F.col("Club").alias("club"),
        F.lit(None).cast("string").alias("transfermarkt_player_id"),
        F.lit(None).cast("int").alias("sofifa_player_id"),
        F.lit(None).cast("double").alias("rating_match_score"),
        F.lit(None).cast("string").alias("rating_match_tier"),
    )
    skipped = named.agg(F.count_if(F.col("player_name").isNull()).alias("skipped"))
    return Star(tournaments, squads, players, skipped)
