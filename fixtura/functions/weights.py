"""Importance tiers, recency decay and their product."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contest labels per tier and the value of each tier. They must
# equal the published lists for importance values to agree.
MAJOR_FINALS = (
    "FIFA World Cup", "UEFA Euro", "Copa América", "African Cup of Nations",
    "AFC Asian Cup", "Gold Cup", "Oceania Nations Cup",
)
SECOND_TIER = (
    "UEFA Nations League", "CONCACAF Nations League", "Confederations Cup",
    "CONMEBOL–UEFA Cup of Champions",
)
REGIONAL = (
    "AFF Championship", "ASEAN Championship", "Arab Cup", "CECAFA Cup",
    "CFU Caribbean Cup", "COSAFA Cup", "EAFF Championship", "Gulf Cup",
    "NAFU Championship", "SAFF Cup", "UNCAF Cup", "UNIFFAC Cup",
    "WAFF Championship", "Baltic Cup", "Nordic Championship",
    "AFC Challenge Cup", "AFC Solidarity Cup",
)
MULTISPORT = (
    "Asian Games", "Pacific Games", "Pacific Mini Games", "South Pacific Games",
    "South Pacific Mini Games", "Southeast Asian Games", "South Asian Games",
    "East Asian Games", "Afro-Asian Games", "Island Games",
    "Indian Ocean Island Games",
)
TIER_VALUES = {
    "friendly": 0.30,
    "major_finals": 1.00,
    "major_qual": 0.60,
    "confed_2nd": 0.55,
    "regional_champ": 0.45,
    "regional_qual": 0.35,
    "multisport": 0.20,
    "default": 0.25,
}
DEFAULT_FLOOR = 0.05


def _qualifiers(labels: Sequence[str]) -> tuple[str, ...]:
    return tuple(f"{label} qualification" for label in labels)


@dataclass(frozen=True)
class Tiers:
    """Ordered label lists per tier; the first list holding a label decides."""

    labels: tuple[tuple[str, tuple[str, ...]], ...]
    values: Mapping[str, float]
    default: str = "default"

    def name(self, label: Column) -> Column:
        expr = F.lit(None).cast("string")
        for tier, members in reversed(self.labels):
            expr = F.when(label.isin(*members), F.lit(tier)).otherwise(expr)
        return F.coalesce(expr, F.lit(self.default))

    def value(self, label: Column, values: Mapping[str, float] | None = None) -> Column:
        """Tier value of a label, under ``values`` if a candidate supplies its own."""
        values = values or self.values
        expr = F.lit(float(values[self.default]))
        for tier, members in reversed(self.labels):
            expr = F.when(label.isin(*members), F.lit(float(values[tier]))).otherwise(expr)
        return expr


FOOTBALL_TIERS = Tiers(
    labels=(
        ("friendly", ("Friendly",)),
        ("major_finals", MAJOR_FINALS),
        ("major_qual", _qualifiers(MAJOR_FINALS)),
        ("confed_2nd", SECOND_TIER),
        ("regional_champ", REGIONAL),
        ("regional_qual", _qualifiers(REGIONAL)),
        ("multisport", MULTISPORT),
    ),
    values=TIER_VALUES,
)


def day_number(date: Column) -> Column:
    """Days since 1970-01-01, so range frames and lags are integer arithmetic."""
    return F.unix_date(date.cast("date"))


def recency(lag_days: Column, half_life: float | Column, floor: float | Column = DEFAULT_FLOOR) -> Column:
    """Halve per ``half_life`` days, but never fall below ``floor``."""
    half_life = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    return F.greatest(F.pow(F.lit(0.5), lag_days / half_life), floor)


def training_weight(
    date: Column,
    importance: Column,
    reference: Column,
    half_life: float | Column = 3650.0,
    floor: float | Column = DEFAULT_FLOOR,
) -> Column:
    """Recency back from ``reference`` times importance; one rule for every fit."""
    return recency(F.datediff(reference, date), half_life, floor) * importance


def with_match_weights(
    contests: DataFrame, reference: str, half_life: float, tiers: Tiers = FOOTBALL_TIERS
) -> DataFrame:
    """Add ``match_weight``; contests after the reference date are dropped, that day is kept."""
    ref = F.to_date(F.lit(reference))
    return contests.filter(F.col("match_date") <= ref).withColumn(
        "match_weight",
        training_weight(F.col("match_date"), tiers.value(F.col("tournament")), ref, half_life),
    )


def tier_values_for_trials(labels: DataFrame, trials: DataFrame, tiers: Tiers) -> DataFrame:
    """Value of every distinct label under each trial's own tier values.

    ``trials`` is (trial_id, tier, value); labels join on their tier name, so a
    label is classified once however many trials there are.
    """
    named = labels.select("tournament").distinct().withColumn("tier", tiers.name(F.col("tournament")))
    return named.join(trials, "tier").select("trial_id", "tournament", "tier", "value")
