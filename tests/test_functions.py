import math

import pytest
from pyspark.sql import functions as F

from fixtura.functions import labels, names, prices, weights


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_decimal_price(spark):
    given = ["+140", "-175", "+100", "1.44", "+1,200", "260", "425", "-1667", "", None, "nan", "0", "-0", "x", "+", "-110.5"]
    want = [2.40, 1 + 100 / 175, 2.0, 1.44, 13.0, 3.60, 5.25, 1 + 100 / 1667] + [None] * 7 + [-110.5]
    assert evaluate(column(spark, given), prices.decimal_price(F.col("v"))) == pytest.approx(want)


@pytest.mark.parametrize(
    "odds, want",
    [((2.0, 4.0, 4.0), (0.5, 0.25, 0.25)), ((None, 3.5, 4.2), None), ((1.0, 3.5, 4.2), None), ((float("nan"), 3.5, 4.2), None)],
)
def test_fair_probabilities(spark, odds, want):
    df = spark.createDataFrame([odds], "h double, d double, a double")
    got = df.select(*[c.alias(n) for n, c in zip("hda", prices.fair_probabilities(*map(F.col, "hda")))]).first()
    assert tuple(got) == (pytest.approx(want) if want else (None, None, None))


def test_fair_probabilities_sum_and_order(spark):
    df = spark.createDataFrame([(1.90, 3.50, 4.20), (1.04, 15.0, 41.0)], "h double, d double, a double")
    rows = df.select(*[c.alias(n) for n, c in zip("hda", prices.fair_probabilities(*map(F.col, "hda")))]).collect()
    assert all(math.isclose(sum(r), 1.0) and r[0] == max(r) for r in rows) and rows[1][0] > 0.90


def test_name_key(spark):
    given = ["İlkay Gündoğan", "Łukasz Fabiański", "Lionel Messi (c)", "Müller, Thomas", "N'Golo Kanté", "Ødegaard", "Großkreutz", "", None, "A.  B-C"]
    want = ["ilkay gundogan", "lukasz fabianski", "lionel messi", "thomas muller", "ngolo kante", "odegaard", "grosskreutz", "", "", "a b c"]
    assert evaluate(column(spark, given), names.name_key(F.col("v"))) == want


def test_similarity(spark):
    df = spark.createDataFrame(
        [("lionel messi", "lionel andres messi cuccitini"), ("", "x"), ("thomas muller", "thomas mueller"), ("harry kane", "bukayo saka")],
        "a string, b string",
    )
    got = [r[0] for r in df.select(names.key_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0
    assert got[2] == pytest.approx(2 * 13 / 27) and got[3] < 0.55


def test_birth_text(spark):
    df = column(spark, ["8 February 1995 (aged 29)", "unknown", None, "31 February 1990 (aged 20)"])
    assert [str(x) for x in evaluate(df, names.birth_date(F.col("v")))] == ["1995-02-08", "None", "None", "None"]
    assert evaluate(df, names.age_at_event(F.col("v"))) == [29, None, None, 20]


def test_player_name(spark):
    df = column(spark, ["Messi (captain)", "Kane*†", "Saka (c)", None])
    assert evaluate(df, names.player_name(F.col("v"))) == ["Messi", "Kane", "Saka (c)", None]
    assert evaluate(df, names.is_captain(F.col("v"))) == [True, False, False, False]


def test_snapshot_reproduces_edition_map(spark):
    df = column(spark, list(labels.EDITION_START.values()) + ["2014-08-31", "2014-09-01", "2030-01-01"])
    got = evaluate(df, labels.snapshot_for_date(F.to_date("v")))
    assert got == list(labels.EDITION_SNAPSHOT.values()) + [None, 15, 24]


def test_edition_lookup_shifts_postponed_year(spark):
    contests = spark.createDataFrame(
        [("UEFA Euro", "2021-06-11"), ("FIFA World Cup", "2018-06-14"), ("FIFA World Cup", "1986-06-01"), ("Friendly", "2018-06-14")],
        "tournament string, d string",
    ).withColumn("match_date", F.to_date("d"))
    editions = spark.createDataFrame([("Euro", 2020, "Euro 2020"), ("World Cup", 2018, "World Cup 2018")], "competition string, year int, name string")
    got = {(r["tournament"], r["d"]): r["edition"] for r in labels.with_edition(contests, editions).collect()}
    assert list(got.values()).count(None) == 2
    assert got["UEFA Euro", "2021-06-11"] == "Euro 2020" and got["FIFA World Cup", "2018-06-14"] == "World Cup 2018"


def test_tiers(spark):
    given = ["Friendly", "UEFA Euro", "UEFA Euro qualification", "UEFA Nations League", "Baltic Cup", "Gulf Cup qualification", "Asian Games", "King's Cup", None]
    df = column(spark, given)
    assert evaluate(df, weights.FOOTBALL_TIERS.value(F.col("v"))) == [0.3, 1.0, 0.6, 0.55, 0.45, 0.35, 0.2, 0.25, 0.25]
    assert evaluate(df, weights.FOOTBALL_TIERS.name(F.col("v")))[1:3] == ["major_finals", "major_qual"]


def test_match_weights_keep_reference_day_and_floor_before_importance(spark):
    rows = [("2000-01-01", "Friendly"), ("2010-01-01", "UEFA Euro"), ("2010-01-02", "UEFA Euro")]
    df = spark.createDataFrame(rows, "d string, tournament string").withColumn("match_date", F.to_date("d"))
    got = {r["d"]: r["match_weight"] for r in weights.with_match_weights(df, "2010-01-01", 365).collect()}
    assert got == {"2000-01-01": pytest.approx(0.05 * 0.3), "2010-01-01": 1.0}


def test_favourite_and_top_class(spark):
    df = spark.createDataFrame([(None, 0.9), (0.5, 0.5), (0.4, 0.5)], "h double, a double")
    assert [r[0] for r in df.select(labels.form_favourite(F.col("h"), F.col("a"))).collect()] == ["H", "H", "A"]
    p = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.2, 0.3, 0.5), (None, None, None)], "h double, d double, a double")
    assert [r[0] for r in p.select(labels.top_class(*map(F.col, "hda"))).collect()] == ["H", "D", "A", None]


def test_footnote_headers(spark):
    df = spark.createDataFrame([(1, 2)], "`Player[4]` int, `No.` int")
    assert names.without_footnotes(df).columns == ["Player", "No."]
