"""Price text to decimal prices to margin-free probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_price(text: Column) -> Column:
    """Decimal price of a decimal or moneyline quote; NULL when it is neither.

    A point marks a decimal quote. A whole number is moneyline: unsigned or
    ``+a`` pays a per 100 staked, ``-a`` needs a staked per 100.
    """
    s = F.regexp_replace(text.cast("string"), r"^\s+|\s+$|,", "")
    amount = F.regexp_extract(s, r"^[+-]?([0-9]+)$", 1).try_cast("double")
    moneyline = F.when(s.startswith("-"), 1.0 + 100.0 / F.nullif(amount, F.lit(0.0))).otherwise(1.0 + amount / 100.0)
    return F.when(s.contains("."), s.try_cast("double")).when(amount != 0.0, moneyline)


def fair_probabilities(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """Inverse prices scaled to sum to one; all NULL unless every price exceeds 1."""
    usable = (home > 1.0) & (draw > 1.0) & (away > 1.0) & ~F.isnan(home) & ~F.isnan(draw) & ~F.isnan(away)
    total = 1.0 / home + 1.0 / draw + 1.0 / away
    return tuple(F.when(usable, (1.0 / price) / total) for price in (home, draw, away))
