"""What fits and matrices leave on disk, and that stored rows are the rows that were asked for."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtura import adapters
from fixtura.functions.weights import FOOTBALL_TIERS
from fixtura.operators import bootstrap, goals, softmax
from fixtura.plans import backtest, matrix, models, tuning
from fixtura.runtime import discard, ensure_checkpoint_dir, written

NUMBERED = ["match_date", "home_team", "away_team", "tournament", "home_score", "away_score", "neutral"]
TEAMS = ["a", "b", "c", "d"]


@pytest.fixture
def stores(spark):
    """Bytes and tables in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def look():
        return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file()), {p.name for p in folder.iterdir()}

    return look


@pytest.fixture(scope="module")
def contests(spark):
    """Contests with repeats, unknown days and editions."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        day = None if i % 97 == 0 else int(rng.integers(10_000, 10_900))
        home, away = rng.choice(4, 2, replace=False)
        date = None if day is None else dt.date(1970, 1, 1) + dt.timedelta(day)
        row = (date, day, TEAMS[home], TEAMS[away], *map(int, rng.integers(0, 4, 2)), ["1-URGENT", "5-LOW"][i % 2], i % 3 == 0, None if i % 2 else "Cup 1998")
        rows += [row] * (1 + (i % 5 == 0))
    return written(spark.createDataFrame(
        rows, "match_date date, day int, home_team string, away_team string, home_score int, away_score int, tournament string, neutral boolean, edition string"
    ))


@pytest.fixture(scope="module")
def table(spark, contests):
    """A matrix of the contests without most features."""
    chance = F.pmod(F.col("day"), F.lit(7)) / 10.0
    blank = {f: F.lit(None).cast("double") for f in matrix.FEATURES if f not in ("neutral", "importance")}
    return written(contests.withColumns({
        **blank, "importance": F.lit(0.5), "neutral": F.col("neutral").cast("int"), "home_form": chance, "away_form": 1 - chance,
        "result": F.when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") == F.col("away_score"), "D").otherwise("A"),
    }))


def test_a_written_table_has_its_rows_and_types_and_can_go(spark, stores):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "x", None)], "a int, `b c` string, d array<double>")
    before = stores()[1]
    kept, none = written(df), written(df.filter("a > 2"))
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == [(1, None, [1.5]), (2, "x", None)]
    assert none.schema == df.schema and none.count() == 0
    discard(kept, none)
    assert stores()[1] == before


def test_rows_to_learn_from_are_not_stored_once_a_fold(table, stores):
    folds = [backtest.Fold(str(y), dt.date(y, 1, 1)) for y in range(1998, 2012)]
    before = stores()
    learn = backtest.learning_rows(table, folds)
    model = models.SoftmaxModel(matrix.BASE_FEATURES).fit(learn, [f.name for f in folds])
    assert stores() == before
    # The first fold starts less than VALID_DAYS after the first contest.
    assert set(model.fitted.coefficients) == {f.name for f in folds[1:]}


def test_a_search_stores_no_rows(table, stores):
    before = stores()
    folds = [backtest.Fold(str(y), dt.date(y, 1, 1), dt.date(y + 1, 1, 1)) for y in (1998, 1999)]
    log = tuning.search_classifier_weighting(table, FOOTBALL_TIERS, 2, folds, matrix.BASE_FEATURES, valid_days=30)
    assert stores() == before and log.count() == 3


def test_passes_of_the_goal_model_leave_nothing_behind(table, stores):
    def tables(max_passes):
        before = stores()[1]
        cells = goals.likelihood_cells(table.withColumns({"fold": F.lit("all"), "neutral": F.col("neutral") == 1}), F.lit(1.0))
        goals.fit_strengths(cells, max_passes=max_passes, tolerance=0)
        return len(stores()[1] - before)

    assert tables(2) == tables(6)


@pytest.mark.parametrize("tasks", [1, 7, 70])
def test_sums_of_a_key_meet_however_many_tasks(spark, tasks):
    rows = spark.range(500).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("fold"), F.array(F.col("id").cast("double")).alias("x"))

    def partial(batch):
        out = {}
        for fold, x in zip(batch.column("fold").to_pylist(), batch.column("x").to_pylist()):
            out[fold] = out.get(fold, np.zeros(1)) + x
        return out

    got = {r.key: r.sums for r in softmax._tree_sums(rows.repartition(tasks), partial).collect()}
    assert got == {"a": [62250.0], "b": [62500.0]} and softmax._tree_sums(rows.repartition(tasks), partial).count() == 2


def test_contests_meet_their_fixture_and_none_is_lost(spark, contests):
    roster = spark.createDataFrame(
        [(t, "Cup 1998", i, "x" if i % 2 else None, "GK", 20 + i, dt.date(1997, 5, 1)) for t in TEAMS[:3] for i in range(12)],
        "team string, edition string, player_id int, club string, position string, age int, seen date",
    )
    pool = roster.select("team", F.lit(0).alias("version"), F.col("seen").alias("first_seen"), (F.col("player_id") + 50).alias("overall"))
    quotes = contests.filter("day % 2 = 0").select("match_date", "home_team", "away_team").distinct().withColumns({f"book_{p}": F.lit(0.3) for p in ("ph", "pd", "pa")})
    out = matrix.build_matrix(contests, F.lit(0.5), roster, pool, F.lit(0), quotes, keep=["day"])
    key = ["match_date", "day", "home_team", "away_team", "tournament", "edition", "home_score", "away_score"]
    assert out.columns == [*matrix.METADATA, *matrix.FEATURES, matrix.LABEL, "day"]
    assert out.select(*key).exceptAll(contests.select(*key)).count() == 0 and contests.select(*key).exceptAll(out.select(*key)).count() == 0
    for r in out.collect():
        squad = r.edition is not None and r.home_team != "d"
        assert r.home_squad_size == (12 if squad else None)
        assert r.home_pool_rating == (55.5 if r.day is not None and r.home_team != "d" else None)
        assert r.book_ph == (0.3 if r.day is not None and r.day % 2 == 0 else None)
        assert r.match_date is not None or r.h2h is None and r.home_form is None


def test_numbers_of_the_matrix_are_those_of_its_contests(spark, sf_dir):
    seen = [*NUMBERED, "row_no"]
    after = written(backtest.numbered_repeats(adapters.matrix(spark, sf_dir), NUMBERED).select(*seen))
    made = adapters.matrix(spark, sf_dir, NUMBERED)
    with_them = written(made.select(*seen))
    assert made.columns == [*matrix.METADATA, *matrix.FEATURES, matrix.LABEL, "row_no"] and with_them.count() > 0
    assert with_them.exceptAll(after).count() == 0 and after.exceptAll(with_them).count() == 0


def test_differences_are_kept_compressed(spark, stores):
    df = spark.range(20_000).select(F.lit("rated - plain").alias("contrast"), F.lit(0.25).alias("diff"), "id")
    before = stores()[0]
    bootstrap.mean_interval(df, "diff", F.col("id"), 10, by=["contrast"]).collect()
    assert stores()[0] - before < 20_000 * 12
