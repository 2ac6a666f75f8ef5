"""Read queries. A bad argument raises ValueError; nothing known returns no row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.weights import recency
from fixtura.operators import squads
from fixtura.operators.form import outcome, side_rows, team_names


def _require(**values: str | None) -> None:
    missing = [name for name, value in values.items() if not value]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")


def _team_history(contests: DataFrame, importance: Column, team: str, as_of: dt.date, half_life: float, years: int | None) -> DataFrame:
    """The team's side of its earlier contests, weighted as of one day.

    The team filter is applied before the rows are doubled, so it reaches the scan.
    """
    today = F.unix_date(F.lit(as_of))
    own = contests.filter((F.col("home_team") == team) | (F.col("away_team") == team)).filter(F.col("day") < today)
    if years is not None:
        own = own.filter(F.col("day") >= today - 365 * years)
    rows = side_rows(own.withColumn("_imp", importance), "_imp").filter(F.col("team") == team)
    return rows.withColumn("w", recency(today - F.col("day"), half_life) * F.col("_imp"))


def _mean(value: Column) -> Column:
    return F.round(F.sum(F.col("w") * value) / F.sum("w"), 3)


def rolling_form(contests: DataFrame, importance: Column, team: str, as_of: dt.date) -> DataFrame:
    _require(team=team)
    rows = _team_history(contests, importance, team, as_of, 730.0, 10)
    form = rows.agg(_mean(outcome(F.col("scored"), F.col("conceded"))).alias("rolling_form"))
    return form.select(F.lit(team).alias("team"), "rolling_form").filter(F.col("rolling_form").isNotNull())


def goal_trend(contests: DataFrame, importance: Column, team: str, as_of: dt.date) -> DataFrame:
    _require(team=team)
    rows = _team_history(contests, importance, team, as_of, 730.0, 10)
    trend = rows.agg(
        _mean(F.col("scored")).alias("goals_scored"),
        _mean(F.col("conceded")).alias("goals_conceded"),
        _mean(F.col("scored") - F.col("conceded")).alias("goal_differential"),
    )
    return trend.select(F.lit(team).alias("team"), "*").filter(F.col("goals_scored").isNotNull())


def head_to_head(contests: DataFrame, importance: Column, team_a: str, team_b: str, as_of: dt.date) -> DataFrame:
    _require(team_a=team_a, team_b=team_b)
    if team_a == team_b:
        raise ValueError("team_a and team_b must differ")
    rows = _team_history(contests, importance, team_a, as_of, 3650.0, None).filter(F.col("opponent") == team_b)
    share = rows.agg(_mean(outcome(F.col("scored"), F.col("conceded"))).alias("h2h_win_rate"))
    return share.select(F.lit(team_a).alias("team_a"), F.lit(team_b).alias("team_b"), "h2h_win_rate").filter(
        F.col("h2h_win_rate").isNotNull()
    )


def _squad(roster: DataFrame, team: str, edition: str) -> DataFrame:
    _require(team=team, edition=edition)
    return roster.filter((F.col("team") == team) & (F.col("edition") == edition))


def squad_age_depth(roster: DataFrame, team: str, edition: str) -> DataFrame:
    shares = {f"share_{p.lower()}": F.round(f"share_{p.lower()}", 3) for p in squads.POSITIONS}
    profile = squads.age_depth(_squad(roster, team, edition))
    return profile.withColumns({"mean_age": F.round("mean_age", 3), **shares}).filter(F.col("mean_age").isNotNull())


def team_chemistry(roster: DataFrame, team: str, edition: str) -> DataFrame:
    ratios = {c: F.round(c, 3) for c in ("club_hhi", "same_club_pair_ratio")}
    return squads.club_concentration(_squad(roster, team, edition)).withColumns(ratios).filter(
        F.col("club_hhi").isNotNull()
    )


def list_teams(contests: DataFrame) -> DataFrame:
    return team_names(contests).orderBy("team")


def list_editions(roster: DataFrame) -> DataFrame:
    return roster.select("edition").distinct().orderBy("edition")
