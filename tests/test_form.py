import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fixtura.operators import form
from fixtura.plans import reads

SCHEMA = "match_date date, home_team string, away_team string, home_score int, away_score int, imp double"


def history(spark, n=400, seed=5):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        home, away = rnd.sample("ABCDE", 2)
        date = dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randrange(2500))
        rows.append((date, home, away, rnd.randrange(4), rnd.randrange(4), rnd.choice([0.2, 0.6, 1.0])))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("day", F.unix_date("match_date"))


def brute(rows, team, date, half_life, floor, window):
    num = den = 0.0
    for d, h, a, hs, as_, imp in rows:
        lag = (date - d).days
        if team not in (h, a) or lag <= 0 or (window is not None and lag > window):
            continue
        own, other = (hs, as_) if h == team else (as_, hs)
        w = max(0.5 ** (lag / half_life), floor) * imp
        num += w * (1.0 if own > other else 0.5 if own == other else 0.0)
        den += w
    return num / den if den else None


@pytest.mark.parametrize("half_life, floor, years", [(180.0, 0.05, 3), (60.0, 0.05, 1), (730.0, 0.05, 10), (90.0, 0.0, 2)])
def test_team_form_matches_brute_force(spark, half_life, floor, years):
    rows, df = history(spark)
    got = form.team_form(df, F.col("imp"), half_life, floor, years).collect()
    assert len(got) == len({(t, r[0]) for r in rows for t in r[1:3]})
    for r in got:
        date = dt.date(1970, 1, 1) + dt.timedelta(days=r["day"])
        assert r["form"] == pytest.approx(brute(rows, r["team"], date, half_life, floor, 365 * years), abs=1e-9)


def test_gap_longer_than_decay_leaves_exact_floor_weights(spark):
    rows = [
        (dt.date(2000, 1, 1), "A", "B", 1, 0, 1.0), (dt.date(2000, 1, 2), "A", "B", 0, 1, 0.6),
        (dt.date(2009, 1, 1), "A", "B", 0, 0, 1.0), (dt.date(2030, 1, 1), "A", "B", 0, 0, 1.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.unix_date("match_date"))
    got = {r["day"]: r["form"] for r in form.team_form(df, F.col("imp"), 100.0).filter("team = 'A'").collect()}
    days = sorted(got)
    assert got[days[0]] is None and got[days[3]] is None
    assert got[days[2]] == pytest.approx(1.0 / 1.6)


def test_future_rows_never_change_the_past(spark):
    rows, df = history(spark)
    cut = dt.date(2004, 1, 1)
    past = form.team_form(df.filter(F.col("match_date") < cut), F.col("imp"), 180.0, window_years=3)
    full = form.team_form(df, F.col("imp"), 180.0, window_years=3).filter(F.col("day") < (cut - dt.date(1970, 1, 1)).days)
    left = {(r["team"], r["day"]): r["form"] for r in past.collect()}
    right = {(r["team"], r["day"]): r["form"] for r in full.collect()}
    assert left.keys() == right.keys()
    assert all(left[k] == pytest.approx(right[k]) for k in left)


def test_pair_record_is_complementary_and_matches_reads(spark):
    rows, df = history(spark)
    as_of = dt.date(2007, 6, 1)
    a = reads.head_to_head(df, F.col("imp"), "A", "B", as_of).first()["h2h_win_rate"]
    b = reads.head_to_head(df, F.col("imp"), "B", "A", as_of).first()["h2h_win_rate"]
    assert a + b == pytest.approx(1.0, abs=1e-3)
    probe = spark.createDataFrame([("A", "B", (as_of - dt.date(1970, 1, 1)).days)], "lo string, hi string, day int")
    share = form.pair_record(df, F.col("imp"), probes=probe).first()["lo_share"]
    assert round(share, 3) == pytest.approx(a, abs=1e-3)


def test_read_queries_reject_bad_arguments(spark):
    _, df = history(spark, 20)
    with pytest.raises(ValueError):
        reads.rolling_form(df, F.col("imp"), "", dt.date(2005, 1, 1))
    with pytest.raises(ValueError):
        reads.head_to_head(df, F.col("imp"), "A", "A", dt.date(2005, 1, 1))
    assert reads.rolling_form(df, F.col("imp"), "Nowhere", dt.date(2005, 1, 1)).count() == 0
    assert [r["team"] for r in reads.list_teams(df).collect()] == sorted(r["team"] for r in reads.list_teams(df).collect())


@pytest.mark.parametrize("half_life, floor, years", [(5.0, 0.05, 3), (2.0, 0.001, 1), (7.0, 0.0, 2), (0.5, 0.05, 1)])
def test_short_half_lives_match_brute_force(spark, monkeypatch, half_life, floor, years):
    monkeypatch.setattr(form, "CUT_HALF_LIVES", 20)
    test_team_form_matches_brute_force(spark, half_life, floor, years)
