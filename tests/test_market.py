"""Quotes: aligned to contests that repeat, and priced once a quote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fixtura import adapters as A
from fixtura.operators import market

DAY = dt.date(2000, 1, 10)
EPOCH = dt.date(1970, 1, 1)


def contests(spark, rows):
    return spark.createDataFrame([((d - EPOCH).days, h, a) for d, h, a in rows], "day int, home_team string, away_team string")


def test_quotes_meet_contests_that_repeat(spark):
    later = DAY + dt.timedelta(2)
    rows = contests(spark, [(DAY, "A", "B"), (later, "B", "A"), (DAY, "C", "A")] * 3)
    quotes = spark.createDataFrame(
        [(1, DAY, "B", "A", 2.0, 4.0, 4.0), (2, later, "A", "B", 2.0, 4.0, 4.0), (3, DAY, "A", "B", 5.0, 5.0, 5.0),
         (4, DAY, "A", "X", 2.0, 4.0, 4.0), (5, DAY, "B", "C", 2.0, 4.0, 4.0), (6, DAY, "A", "C", 1.0, 4.0, 4.0)],
        "quote_no long, match_date date, home_raw string, away_raw string, odds_home double, odds_draw double, odds_away double",
    )
    for given in (rows, rows.distinct()):
        found = market.align_quotes(quotes, given, {})
        got = {(r.quote_no, r.match_date, r.home_team, r.book_ph, r.book_pa) for r in found.resolved.collect()}
        assert got == {(1, DAY, "A", 0.25, 0.5), (2, later, "B", 0.25, 0.5)}
        assert [(r.quote_no, r.home, r.away) for r in found.unknown_teams.collect()] == [(4, "A", None)]
        assert [r.quote_no for r in found.unknown_fixtures.collect()] == [5]


def test_prices_are_worked_out_after_quotes_are_made_distinct(spark):
    rows = contests(spark, [(DAY, "NATION_3", "NATION_4")])
    priced = A.quotes(spark, "", rows).filter("odds_home > 1 AND odds_away > 1")
    below = priced._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]
    assert "Filter" not in below and "regexp" not in below
    assert priced.count() == A.price_texts(spark, "", rows).filter(~F.col("text_home").isin("-")).count()
