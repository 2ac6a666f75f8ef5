import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtura.operators import bootstrap, clean, guards, metrics, squads
from fixtura.plans import backtest, matrix, models, tuning
from fixtura.functions.weights import FOOTBALL_TIERS


def test_interval_agrees_with_resampling(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.02, 0.5, 800)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, diff double")
    got = bootstrap.mean_interval(df, "diff", F.col("k"), 2000).first()
    means = x[rng.integers(0, len(x), size=(4000, len(x)))].mean(axis=1)
    lo, hi = np.percentile(means, [2.5, 97.5])
    width = hi - lo
    assert got["point"] == pytest.approx(x.mean())
    assert abs(got["lo"] - lo) < 0.1 * width and abs(got["hi"] - hi) < 0.1 * width


def test_draw_counts_are_poisson_for_any_identity():
    rows = np.concatenate([np.arange(200), np.arange(100) + 2**48, -np.arange(1, 101) * 2**40]).astype(np.int64)
    counts = bootstrap.draws(rows, np.arange(250, dtype=np.int64), 7)
    for k in range(4):
        assert (counts == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)
    assert len({tuple(c) for c in counts.tolist()}) == len(rows)


def test_verdicts(spark):
    df = spark.createDataFrame([(0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1)], "lo double, hi double")
    assert [r[0] for r in df.select(bootstrap.verdict(F.col("lo"), F.col("hi"))).collect()] == ["worse", "better", "within noise"]


def forecasts(spark, n=600):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        p = rng.dirichlet([3, 2, 2])
        rows.append((i, "HDA"[rng.choice(3, p=p)], *map(float, p)))
    return rows, spark.createDataFrame(rows, "k int, result string, ph double, pd double, pa double")


def test_quantiles_and_reliability(spark):
    rows, df = forecasts(spark)
    ph = np.array([r[2] for r in rows])
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    assert metrics.quantiles(df, "ph", shares) == pytest.approx(list(np.quantile(ph, shares)))
    bins = metrics.reliability(df)
    edges = np.quantile(ph, np.linspace(0, 1, 11))[1:-1]
    ids = np.searchsorted(edges, ph)
    got = {r["bin"]: r for r in bins.collect()}
    for b in range(10):
        assert got[b]["predicted"] == pytest.approx(ph[ids == b].mean())
    _, old_edges = np.histogram(ph, bins=10)
    want = sum(
        np.mean((ph >= lo) & (ph <= hi)) * got[b]["gap"] for b, (lo, hi) in enumerate(zip(old_edges, old_edges[1:]))
    )
    assert metrics.calibration_error_equal_width(df, bins) == pytest.approx(want, abs=0.01)


def test_guards(spark):
    rows, df = forecasts(spark, 20)
    assert guards.improper_probabilities(df).count() == 0
    assert guards.improper_probabilities(df.withColumn("pa", F.col("pa") + 0.1)).count() == 20
    assert guards.misaligned(df, df, ["k"]).count() == 0
    assert guards.misaligned(df, df.filter("k > 0"), ["k"]).count() == 1
    assert guards.row_count_gap(df, df).count() == 0 and guards.row_count_gap(df, df.limit(3)).count() == 1
    assert guards.coverage_gap(df, "k", range(20)).count() == 0 and guards.coverage_gap(df, "k", range(19)).count() == 1
    assert guards.orphans(df, df.filter("k > 1"), "k").count() == 2
    assert guards.leaking_features(matrix.FEATURES) == [] and guards.leaking_features(["h2h", "book_ph"]) == ["book_ph"]
    assert sorted(sum((matrix.BASE_FEATURES, matrix.SQUAD_FEATURES, matrix.RATING_FEATURES), [])) == sorted(matrix.FEATURES)


def test_concentration_known_answers(spark):
    spread = [("X", "e", f"c{i}", "GK", 25) for i in range(26)]
    loners = [("Y", "e", None, "DF", 20)]
    pair = [("Z", "e", "a", "MF", 20), ("Z", "e", "a", "FW", 30), ("Z", "e", None, "FW", None)]
    roster = spark.createDataFrame(spread + loners + pair, "team string, edition string, club string, position string, age int")
    got = {r["team"]: r.asDict() for r in squads.club_concentration(roster).collect()}
    assert round(got["X"]["club_hhi"], 3) == 0.038 and got["X"]["largest_club_bloc"] == 1 and got["X"]["same_club_pairs"] == 0
    assert got["Y"]["club_hhi"] is None and got["Y"]["same_club_pair_ratio"] is None and got["Y"]["n_distinct_clubs"] == 0
    assert got["Z"]["club_hhi"] == pytest.approx(4 / 9) and got["Z"]["same_club_pair_ratio"] == pytest.approx(1 / 3)
    ages = {r["team"]: r.asDict() for r in squads.age_depth(roster).collect()}
    assert ages["Z"]["mean_age"] == 25.0 and ages["Z"]["squad_size"] == 3 and ages["Z"]["n_gk"] == 0


def test_clean_order_and_first_rename_wins(spark):
    raw = spark.createDataFrame(
        [("1985-01-01", "Old", "B", 1, 0, "Friendly"), ("1995-01-01", "Old", "B", 1, 0, "Friendly"), ("1995-01-01", "Old", "B", None, 0, "Friendly"),
         ("1996-01-01", "Old", "B", 1, 0, "Viva World Cup"), ("2005-01-01", "Old", "B", 1, 0, "Friendly")],
        "d string, home_team string, away_team string, home_score int, away_score int, tournament string",
    ).withColumn("match_date", F.to_date("d"))
    names = spark.createDataFrame(
        [(2, "Old", "Second", "1990-01-01", "1999-12-31"), (1, "Old", "First", "1994-01-01", "1995-01-01")],
        "row_no int, former string, current string, s string, e string",
    ).select("row_no", "former", "current", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    got = sorted((r["d"], r["home_team"]) for r in clean.clean_contests(raw, names).collect())
    assert got == [("1995-01-01", "First"), ("2005-01-01", "Old")]


@pytest.fixture(scope="module")
def small_matrix(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        h, a = rng.choice(6, 2, replace=False)
        date = dt.date(2010, 1, 1) + dt.timedelta(days=int(i * 3))
        hs, as_ = int(rng.poisson(1.6 + 0.2 * h)), int(rng.poisson(1.1))
        edition = f"Cup {date.year}" if i % 3 == 0 else None
        quoted = i % 5 != 0
        rows.append((i, date, f"T{h}", f"T{a}", "Friendly", edition, hs, as_, int(i % 4 == 0), 0.3, 0.1 * float(h), 0.1 * float(a),
                     "H" if hs > as_ else "D" if hs == as_ else "A", float(h - a) if i % 2 else None,
                     *((0.5, 0.3, 0.2) if quoted else (None, None, None))))
    schema = ("k int, match_date date, home_team string, away_team string, tournament string, edition string, home_score int, away_score int,"
              "neutral int, importance double, home_form double, away_form double, result string, rating_gap double,"
              "book_ph double, book_pd double, book_pa double")
    return spark.createDataFrame(rows, schema)


def scored(df, model, folds, by_edition=True):
    rows = backtest.walk_forward(df, model, folds, by_edition).collect()
    return {r["k"]: (r["fold"], r["ph"], r["pd"], r["pa"], r["base_ph"]) for r in rows}


def test_walk_forward_never_sees_its_future(spark, small_matrix):
    folds = backtest.edition_folds(small_matrix, 2014)
    assert [f.name for f in folds] == ["Cup 2014", "Cup 2015", "Cup 2016", "Cup 2017"]
    model = models.GoalModel(max_passes=8)
    before = scored(small_matrix, model, folds[:1])
    changed = small_matrix.withColumn("home_score", F.when(F.col("match_date") >= F.lit(folds[0].start), 9).otherwise(F.col("home_score")))
    after = scored(changed, models.GoalModel(max_passes=8), folds[:1])
    assert before.keys() == after.keys() and len(before) > 20
    for k in before:
        assert before[k][1:] == pytest.approx(after[k][1:], abs=1e-9)
        assert sum(before[k][1:4]) == pytest.approx(1.0)


def test_learning_rows_split_and_weights(spark, small_matrix):
    fold = backtest.Fold("f", dt.date(2014, 1, 1), dt.date(2015, 1, 1))
    rows = backtest.learning_rows(small_matrix, [fold]).select("match_date", "part", "weight").collect()
    assert max(r["match_date"] for r in rows) < fold.start
    assert {r["part"] for r in rows if r["match_date"] >= dt.date(2013, 1, 1)} == {"valid"}
    r = rows[0]
    assert r["weight"] == pytest.approx(max(0.5 ** ((fold.start - r["match_date"]).days / 3650), 0.05) * 0.3)


def test_softmax_and_boosted_models_score_every_row(spark, small_matrix):
    folds = [backtest.Fold("a", dt.date(2014, 1, 1), dt.date(2015, 1, 1)), backtest.Fold("b", dt.date(2015, 1, 1), dt.date(2016, 1, 1))]
    features = ["home_form", "away_form", "rating_gap", "neutral"]
    n = small_matrix.filter("match_date >= '2014-01-01' and match_date < '2016-01-01'").count()
    for model in (models.SoftmaxModel(features), models.BoostedModel(features, {"max_trees": 2, "max_depth": 2})):
        got = scored(small_matrix, model, folds, by_edition=False)
        assert len(got) == n and all(sum(v[1:4]) == pytest.approx(1.0) for v in got.values())


def test_annual_scores_only_quoted_and_contrasts_pair_by_key(spark, small_matrix):
    rows = backtest.annual_walk_forward(small_matrix.filter("match_date < '2013-01-01'"), models.GoalModel(max_passes=5))
    assert rows.filter("book_ph is null").count() == 0
    both = backtest.compare({"a": rows, "b": backtest.reference_forecasts(rows, "book")}, ["k"])
    interval = backtest.contrasts(both, ["k"], [("a", "b")], 50).first()
    assert interval["n"] == rows.count() and interval["lo"] <= interval["point"] <= interval["hi"]
    assert backtest.changed_rows(rows, rows, ["k"]).first()["n_changed"] == 0


def test_best_prefix_waits():
    losses = [5.0, 4.0, 4.5, 4.4, 3.9, 4.0, 4.0, 4.0]
    assert models.best_prefix(losses, 3) == (5, True) and models.best_prefix(losses, 2) == (2, True)
    assert models.best_prefix(losses, 4) == (5, False) and models.best_prefix([1.0], 5) == (1, False)


def test_boosting_keeps_many_trees_and_beats_base_rates(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x, y = rng.normal(size=2)
        p = np.exp([1.2 * x, 0.0, -1.2 * x + 0.5 * y])
        part = ("train", "valid", "score")[i % 3]
        rows.append(("f", part, 1.0, float(x), float(y), "HDA"[rng.choice(3, p=p / p.sum())]))
    df = spark.createDataFrame(rows, "fold string, part string, weight double, x double, y double, result string")
    model = models.BoostedModel(["x", "y"], {"max_trees": 60, "max_depth": 2, "patience": 10})
    model.fit(df.filter("part <> 'score'"), ["f", "empty"])
    assert set(model.trees()) == {("f", c) for c in "HDA"} and min(model.trees().values()) > 5
    asked = df.filter("part = 'score'")
    scored = model.score(asked.unionByName(asked.limit(4).withColumn("fold", F.lit("empty"))))
    got = {r["fold"]: r for r in backtest.fold_scores(scored).collect()}
    share = asked.groupBy("result").count().collect()
    base = -sum(r["count"] / 300 * math.log(r["count"] / 300) for r in share)
    assert got["f"]["n"] == 300 and got["f"]["n_unscored"] == 0 and got["f"]["log_loss"] < base - 0.05
    assert (got["empty"]["n"], got["empty"]["n_unscored"], got["empty"]["log_loss"]) == (0, 4, None)


def test_repeats_get_numbers_of_their_own(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "k int, v string")
    rows = backtest.numbered_repeats(df, ["k", "v"])
    assert rows.count() == 5 and rows.select("row_no").distinct().count() == 5


def test_rolling_folds_stop_at_the_wall():
    folds = backtest.rolling_folds()
    assert len(folds) == 6 and folds[0].start == dt.date(2004, 1, 1) and max(f.end for f in folds) == dt.date(2016, 1, 1)


def test_candidates_are_bounded_and_reproducible(spark):
    rows = tuning.candidates(spark, 50).collect()
    assert rows == tuning.candidates(spark, 50).repartition(7).orderBy("trial_id").collect()
    base = rows[0]
    assert (base["half_life"], base["floor"], base["tier_friendly"], base["max_depth"]) == (3650.0, 0.05, 0.3, 4)
    for r in rows[1:]:
        assert 365 <= r["half_life"] <= 14600 and 0 <= r["floor"] <= 0.3 and r["tier_major_finals"] == 1.0
        assert 0.05 <= r["tier_default"] <= 1 and 3 <= r["max_depth"] <= 8 and 1 <= r["min_child_weight"] <= 12
        assert 0.01 <= r["learning_rate"] <= 0.3 and 0.1 <= r["reg_lambda"] <= 10
    assert all(tuning.active_changes(rows[1].asDict(), base.asDict()).values())


def test_candidate_weighting_moves_feature_and_weight_together(spark, small_matrix):
    trial = tuning.candidates(spark, 1).orderBy("trial_id").collect()[1].asDict()
    remapped, rule = tuning.with_candidate_weighting(small_matrix, FOOTBALL_TIERS, trial)
    row = remapped.withColumn("w", rule(F.col("match_date"), F.col("importance"), F.lit(dt.date(2018, 1, 1)))).first()
    assert row["importance"] == pytest.approx(trial["tier_friendly"])
    lag = (dt.date(2018, 1, 1) - row["match_date"]).days
    assert row["w"] == pytest.approx(max(0.5 ** (lag / trial["half_life"]), trial["floor"]) * trial["tier_friendly"])


def test_objective_and_search(spark, small_matrix):
    folds = backtest.rolling_folds(2013, 2015, 1)
    one = tuning.objective(small_matrix, models.GoalModel(max_passes=5), folds).first()
    assert one["last_scored"] < dt.date(2015, 1, 1) and one["log_loss"] > 0
    contests = small_matrix.withColumn("neutral", F.col("neutral").cast("boolean"))
    log = tuning.search_goal_weighting(contests, FOOTBALL_TIERS, 2, folds)
    rows = log.orderBy("trial_id").collect()
    assert len(rows) == 3 and rows[0]["is_best_so_far"] and rows[0]["n"] == one["n"]
    assert rows[0]["log_loss"] == pytest.approx(
        tuning.objective(small_matrix, models.GoalModel(), folds, None).first()["log_loss"], abs=0.05
    )
    assert tuning.proposal(log).first()["log_loss"] == min(r["log_loss"] for r in rows)


def test_classifier_weighting_search_halves_and_stays_before_the_wall(spark, small_matrix):
    folds, features = backtest.rolling_folds(2013, 2017, 1), ["importance", "home_form", "away_form"]
    log = tuning.search_classifier_weighting(small_matrix, FOOTBALL_TIERS, 5, folds, features).orderBy("trial_id").collect()
    assert [r["trial_id"] for r in log] == list(range(6)) and tuning.rungs(4) == [1, 2, 4]
    assert sorted(r["rung"] for r in log)[:2] == [1, 1] and log[0]["rung"] == 3 and max(r["last_scored"] for r in log) < dt.date(2017, 1, 1)
    # A trial is worth what a walk-forward of its own gives.
    for row in log:
        trial = tuning.candidates(spark, 5, hyper=False).filter(F.col("trial_id") == row["trial_id"]).first().asDict()
        remapped, rule = tuning.with_candidate_weighting(small_matrix, FOOTBALL_TIERS, trial)
        if row["rung"] == 3:
            one = tuning.objective(remapped, models.SoftmaxModel(features), folds[: row["n_folds"]], rule).first()
            assert row["log_loss"] == pytest.approx(one["log_loss"], abs=1e-5) and row["n"] == one["n"]
    best = tuning.weighting_proposal(tuning.search_classifier_weighting(small_matrix, FOOTBALL_TIERS, 5, folds, features)).first()
    assert best["log_loss"] == min(r["log_loss"] for r in log if r["n_folds"] == 4)


def test_weighting_verdict_pairs_baseline_and_proposal(spark, small_matrix):
    trial = tuning.candidates(spark, 1, hyper=False).filter("trial_id = 0").first().asDict()
    held_out = backtest.rolling_folds(2015, 2017, 1)
    n = small_matrix.filter("match_date >= '2015-01-01' AND match_date < '2017-01-01'").count()
    same = tuning.weighting_verdict(small_matrix, FOOTBALL_TIERS, trial, held_out, lambda: models.SoftmaxModel(["importance", "home_form"]), ["k"], 50).first()
    assert same["n"] == n and same["verdict"] == "within noise" and same["point"] == pytest.approx(0, abs=1e-9)


def test_held_out_verdict(spark):
    rows, df = forecasts(spark, 200)
    worse = df.select("k", "result", *[F.lit(1 / 3).alias(p) for p in ("ph", "pd", "pa")])
    assert tuning.held_out_verdict(worse, df, ["k"], 200).first()["verdict"] == "better"
    assert tuning.held_out_verdict(df, df, ["k"], 50).first()["verdict"] == "within noise"


def test_evaluate_sums_up_rows_without_multiplying_them(spark):
    rows, df = forecasts(spark, 200)
    df = df.withColumn("fav", F.when(F.col("k") % 3 == 0, "A").otherwise("H"))
    late = F.when(F.col("k") > 0, F.col("k") >= 150)  # unknown for the first row
    table = metrics.evaluate(df, F.col("fav"), (0.5, 0.2, 0.3), {"all": F.lit(True), "late": late, "none": F.col("k") < 0})
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("Aggregate", 1)[1]
    got = {(r["slice"], r["predictor"]): r for r in table.collect()}
    assert {s for s, _ in got} == {"all", "late"} and len(got) == 8
    for part, own in (("all", rows), ("late", [r for r in rows if r[0] >= 150])):
        p = [dict(zip("HDA", r[2:]))[r[1]] for r in own]
        model, flat, fav = (got[part, name] for name in ("model", "base_rate", "form_favourite"))
        assert model["n"] == flat["n"] == len(own) and flat["accuracy"] is None and fav["log_loss"] is None
        assert model["log_loss"] == pytest.approx(-np.log(p).mean())
        assert model["accuracy"] == pytest.approx(np.mean([max(r[2:]) == q for r, q in zip(own, p)]))
        assert flat["log_loss"] == pytest.approx(-np.mean([math.log(dict(H=0.5, D=0.2, A=0.3)[r[1]]) for r in own]))
        assert fav["accuracy"] == pytest.approx(np.mean([r[1] == ("A" if r[0] % 3 == 0 else "H") for r in own]))
        assert got[part, "always_home"]["accuracy"] == pytest.approx(np.mean([r[1] == "H" for r in own]))


def test_draws_follow_their_formula_for_any_identity():
    m = bootstrap.MODULUS
    rows = [0, 1, -1, m - 1, m, m + 1, m * m, 2**63 - 1, -(2**63), 123456789012345678]
    for seed in (0, 42, 2**40):
        got = bootstrap.draws(np.array(rows, np.int64), np.arange(500, dtype=np.int64), seed)
        for row, counts in zip(rows, got.tolist()):
            low, high = row % m, row // m % m
            for b, c in enumerate(counts):
                x = (low * 48271 + b * 69621 + seed % m * 16807 + 12345) % m
                y = (x * x + low + high) % m
                z = (y * 48271 + b * 40692 + high) % m
                assert c == sum((z * z + y) % m >= limit for limit in bootstrap.poisson_limits())


def test_interval_works_differences_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(300).selectExpr("id AS k", "id % 7 - 3D AS diff").mapInPandas(count, "k long, diff double")
    got = bootstrap.mean_interval(rows, "diff", F.col("k"), 50).first()
    assert got["n"] == 300 and seen.value == 300
