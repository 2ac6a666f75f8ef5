"""Quotes: team resolution, nearest-date alignment to fixtures, review queues."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.prices import fair_probabilities
from fixtura.operators.form import team_names
from fixtura.operators.ordered import keep_first
from fixtura.runtime import materialise, sized_broadcast, with_once

DATE_TOLERANCE = 3
DAY_SHIFT = 1_000_000  # keeps ranks of days before 1970 positive
RANK_SPAN = 1 << 58  # contest ranks stay below this, so days apart always decide first
MAX_TOLERANCE = 31  # more days than this times RANK_SPAN do not fit into 64 bits

# Source spellings checked by hand against the contest table.
TEAM_ALIASES = {
    "Bosnia & Herzegovina": "Bosnia and Herzegovina",
    "Ireland": "Republic of Ireland",
    "USA": "United States",
    "D.R. Congo": "DR Congo",
    "Guinea Bissau": "Guinea-Bissau",
    "Central Africa": "Central African Republic",
    "Chinese Taipei": "Taiwan",
    "Curacao": "Curaçao",
    "Sao Tome and Principe": "São Tomé and Príncipe",
    "Trinidad & Tobago": "Trinidad and Tobago",
}


class AlignedQuotes(NamedTuple):
    resolved: DataFrame
    unknown_teams: DataFrame
    unknown_fixtures: DataFrame


def alias_of(name: Column, aliases: Mapping[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for source, canonical in aliases.items():
        expr = F.when(name == source, F.lit(canonical)).otherwise(expr)
    return expr


def canonical_teams(
    df: DataFrame, members: DataFrame, columns: Mapping[str, str], aliases: Mapping[str, str] = TEAM_ALIASES
) -> DataFrame:
    """Add the canonical name of each raw name column, or NULL; never a fuzzy guess.

    A checked alias decides first and is taken as it stands; otherwise the raw name
    must be a member exactly. ``columns`` maps raw to output column.
    """
    known = sized_broadcast(members.select(F.col("team").alias("_member")))
    for raw, out in columns.items():
        df = df.join(known.withColumnRenamed("_member", f"_{out}"), F.col(raw) == F.col(f"_{out}"), "left")
        df = df.withColumn(out, F.coalesce(alias_of(F.col(raw), aliases), F.col(f"_{out}"))).drop(f"_{out}")
    return df


def align_quotes(
    quotes: DataFrame,
    contests: DataFrame,
    aliases: Mapping[str, str] = TEAM_ALIASES,
    tolerance: int = DATE_TOLERANCE,
    contest_order: str | None = None,
) -> AlignedQuotes:
    """Fair probabilities in the contest table's own home/away order.

    ``quotes`` is (quote_no, match_date, home_raw, away_raw, odds_home, odds_draw,
    odds_away). A quote meets the nearest fixture of the same two teams within
    ``tolerance`` days; equally near fixtures rank by ``contest_order``, a non-negative
    row number (default: date, then home name). Each fixture keeps its first quote. Unusable prices drop
    out before names are resolved.

    The search runs on distinct (pair, day) keys: fixtures keep one row per key,
    quotes ask once per key, and each ask is a plain equi-join over the few days in
    reach. A pair with very many rows therefore never multiplies against itself. Only
    ``day`` and the two names of ``contests`` are read (and ``contest_order``), several times:
    pass their distinct rows, stored. Priced quotes are stored once. Day,
    side and rank travel as whole numbers, which keeps both aggregations hashed.
    """
    if not 0 <= tolerance <= MAX_TOLERANCE:
        raise ValueError(f"tolerance must be between 0 and {MAX_TOLERANCE} days")
    ph, pd_, pa = fair_probabilities(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))
    priced = with_once(quotes, {"ph": ph, "pd": pd_, "pa": pa}).filter(F.col("ph").isNotNull())
    named = materialise(canonical_teams(priced, team_names(contests), {"home_raw": "home", "away_raw": "away"}, aliases))
    known = F.col("home").isNotNull() & F.col("away").isNotNull()
    pair = [F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")]
    asked = named.filter(known).select("*", *pair, F.unix_date("match_date").alias("day"))

    lo, home_is_lo = F.least("home_team", "away_team"), F.col("home_team") < F.col("away_team")
    rank = F.col(contest_order) if contest_order else (F.col("day") + DAY_SHIFT) * 2 + (~home_is_lo).cast("int")
    fixtures = (
        contests.select(
            lo.alias("lo"), F.greatest("home_team", "away_team").alias("hi"), "day",
            rank.cast("bigint").alias("rank"), (F.col("day") * 2 + home_is_lo.cast("int")).alias("place"),
        )
        .groupBy("lo", "hi", "day")
        .agg(F.min("rank").alias("rank"), F.min_by("place", "rank").alias("place"))
    )
    in_reach = F.explode(F.sequence(F.col("day") - tolerance, F.col("day") + tolerance))
    closeness = F.abs(F.col("day") - F.col("asked_day")) * F.lit(RANK_SPAN) + F.col("rank")
    place = F.col("place")
    nearest = (
        asked.select("lo", "hi", "day")
        .distinct()
        .select("lo", "hi", F.col("day").alias("asked_day"), in_reach.alias("day"))
        .join(fixtures, ["lo", "hi", "day"])
        .groupBy("lo", "hi", F.col("asked_day").alias("day"))
        .agg(F.min_by("place", closeness).alias("place"))
        .select(
            "lo",
            "hi",
            "day",
            F.date_from_unix_date(F.floor(place / 2).cast("int")).alias("match_date"),
            F.when(F.pmod(place, F.lit(2)) == 1, F.col("lo")).otherwise(F.col("hi")).alias("home_team"),
            F.when(F.pmod(place, F.lit(2)) == 1, F.col("hi")).otherwise(F.col("lo")).alias("away_team"),
        )
    )
    placed = asked.drop("match_date").join(nearest, ["lo", "hi", "day"])
    same_side = F.col("home_team") == F.col("home")
    oriented = placed.select(
        "quote_no",
        "match_date",
        "home_team",
        "away_team",
        F.when(same_side, F.col("ph")).otherwise(F.col("pa")).alias("book_ph"),
        F.col("pd").alias("book_pd"),
        F.when(same_side, F.col("pa")).otherwise(F.col("ph")).alias("book_pa"),
    )
    return AlignedQuotes(
        resolved=keep_first(oriented, ["match_date", "home_team", "away_team"], ["quote_no"]),
        unknown_teams=named.filter(~known).select("quote_no", "home_raw", "away_raw", "home", "away"),
        unknown_fixtures=asked.join(nearest.select("lo", "hi", "day"), ["lo", "hi", "day"], "left_anti").select(
            "quote_no", "match_date", "home", "away"
        ),
    )
