"""Rating joins: results, and no table of ratings is sent whole to the driver."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtura import adapters as A
from fixtura import runtime
from fixtura.operators import squads
from workload import queries

DAY = dt.date(2000, 1, 1)


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame(
        [(1, 0, 60, 70), (1, 1, 61, 71), (2, 0, 50, 55)], "player_id long, version int, overall int, potential int"
    )


def test_pool_and_era_joins_are_not_broadcast(spark):
    # An inline table has a known size, far below the one at which Spark would shuffle by itself.
    small = spark.sql("SELECT * FROM VALUES (1L, 0, 60, 70), (2L, 0, 50, 55) AS t(player_id, version, overall, potential)")
    seen = spark.createDataFrame([("A", 1, DAY)], "team string, player_id long, first_seen date")
    roster = spark.createDataFrame([("A", "Cup 1", 1), ("A", "Cup 1", 2)], "team string, edition string, player_id long")
    for joined in (squads.team_pool(seen, small), squads.era_ratings(roster, small, {"Cup 1": 0})):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_joins_keep_repeats_and_unknown_players(spark, ratings):
    seen = spark.createDataFrame([("A", 1, DAY), ("B", 1, DAY), ("A", 3, DAY), ("A", None, DAY)], "team string, player_id long, first_seen date")
    twice = ratings.unionByName(ratings.filter(F.col("version") == 1))
    got = squads.team_pool(seen, twice).groupBy("team", "version").agg(F.count("overall").alias("n")).collect()
    assert {(r.team, r.version): r.n for r in got} == {("A", 0): 1, ("A", 1): 2, ("B", 0): 1, ("B", 1): 2}
    roster = spark.createDataFrame([("A", "Cup 1", 1), ("A", "Cup 1", 9), ("A", "Cup 1", None), ("A", "no cup", 2)], "team string, edition string, player_id long")
    era = squads.era_ratings(roster, ratings, {"Cup 1": 0}).collect()
    assert sorted((r.player_id or -1, r.overall or -1) for r in era) == [(-1, -1), (1, 60), (9, -1)]


def test_large_lookups_are_not_broadcast_by_their_estimated_size(spark):
    side = spark.range(100).withColumnRenamed("id", "k")
    for bound, how in ((100, "BroadcastHashJoin"), (99, "SortMergeJoin")):
        joined = spark.range(10).withColumnRenamed("id", "k").join(runtime.sized_broadcast(side, bound), "k")
        assert how in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 10


def test_contests_count_customers_and_suppliers_before_they_are_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(A, "sized_broadcast", lambda df: runtime.sized_broadcast(df, 0))
    for rows in (A.contests(spark, sf_dir), A.rosters(spark, sf_dir)):
        assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_late_players_are_counted_by_first_day(spark, monkeypatch):
    pool = spark.createDataFrame([("A", 0, 1, DAY), ("A", 0, 2, DAY), ("A", 0, 3, None), ("A", 1, 1, DAY), ("B", 0, 1, DAY)], "team string, version int, player_id long, first_seen date")
    days = spark.createDataFrame([("A", DAY - dt.timedelta(1)), ("A", DAY), ("C", DAY)], "team string, match_date date")
    joined = []

    def watched(use):
        joined.append(use.count())
        return guards_unknown(use)

    guards_unknown = queries.guards.unknown_at_match
    monkeypatch.setattr(queries, "_pool", lambda s, d: pool)
    monkeypatch.setattr(queries, "_team_days", lambda s, d: days)
    monkeypatch.setattr(queries.A, "version_of", lambda date: F.lit(0))
    monkeypatch.setattr(queries.guards, "unknown_at_match", watched)
    got = queries.QUERIES["guard_pool_dates"](spark, "").collect()
    assert [(r.team, r.match_date, r.n_late) for r in got] == [("A", "1999-12-31", 2)]
    assert joined == [4]  # two days of A with two first days, one of them unknown; three players each before
