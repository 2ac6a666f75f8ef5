import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtura import schemas
from fixtura.operators import ordered
from fixtura.sources import pages, quotes, tables

PASTE = """15 Jul 2024 - Play Offs
1
X
2
Finished

Spain
2
–
1
England
+140
+179
260
Cancelled
Brazil
–
Argentina
-
-
-
14 Jul 2024
1
X
2
AET
France
0
–
0
Portugal
2.10
3.20
3.90
"""
EXPORT = """date,home_team,away_team,odds_home,odds_draw,odds_away,competition
10 Jul 2024 - Semi-finals,Netherlands,England,+180,+200,+175,Euro
,"Spain","France, A",1.90,3.40,-110,Euro
9 Jul 2024,Spain,England,2.0,3.0,4.0,Euro
not a date,Spain,Italy,2.0,3.0,4.0,Euro
14 Jul 2024,France,Portugal,9.0,9.0,9.0,Euro
"""


def test_load_quotes_reads_both_dialects(spark, tmp_path):
    (tmp_path / "a_odds.csv").write_text(PASTE, encoding="utf-8")
    (tmp_path / "b_odds.csv").write_text(EXPORT, encoding="utf-8")
    got = {
        (str(r["match_date"]), r["home_raw"], r["away_raw"]): r.asDict()
        for r in quotes.load_quotes(spark, f"{tmp_path}/*odds*.csv").collect()
    }
    assert len(got) == 6
    final = got["2024-07-15", "Spain", "England"]
    assert (final["odds_home"], final["odds_away"], final["stage"], final["source"]) == (2.4, 3.6, "Play Offs", "a_odds.csv")
    assert got["2024-07-15", "Brazil", "Argentina"]["odds_home"] is None
    # A date line without a stage clears it in a paste; an export carries the old one on.
    assert got["2024-07-14", "France", "Portugal"]["stage"] is None
    assert got["2024-07-14", "France", "Portugal"]["odds_home"] == 2.1
    assert got["2024-07-10", "Spain", "France, A"]["odds_away"] == pytest.approx(1 + 100 / 110)
    assert got["2024-07-09", "Spain", "England"]["stage"] == "Semi-finals"


def test_no_files_is_empty_and_short_header_is_an_error(spark, tmp_path):
    assert quotes.load_quotes(spark, f"{tmp_path}/*odds*.csv").count() == 0
    (tmp_path / "bad_odds.csv").write_text("date,home_team,away_team\n1 Jan 2024,A,B\n", encoding="utf-8")
    with pytest.raises(ValueError, match="odds_home"):
        quotes.load_quotes(spark, f"{tmp_path}/*odds*.csv")


def test_malformed_paste_is_an_error(spark, tmp_path):
    (tmp_path / "x_odds.csv").write_text(PASTE.replace("Finished\n", ""), encoding="utf-8")
    with pytest.raises(ValueError, match="shape of the paste breaks"):
        quotes.load_quotes(spark, f"{tmp_path}/*odds*.csv")


@pytest.mark.parametrize(
    "change", [lambda t: t.replace("+179\n", "") + "surplus\n", lambda t: t.replace("14 Jul 2024\n1\n", "14 Jul 2024\n"), lambda t: t + "tail\n"]
)
def test_shifted_paste_is_an_error(spark, tmp_path, change):
    (tmp_path / "x_odds.csv").write_text(change(PASTE), encoding="utf-8")
    with pytest.raises(ValueError, match="shape of the paste breaks"):
        quotes.load_quotes(spark, f"{tmp_path}/*odds*.csv")


def test_short_rows_and_doubled_quotes(spark, tmp_path):
    text = EXPORT + '8 Jul 2024,"The ""Reds""",Wales,2.0\n7 Jul 2024,Spain,Italy,2.0,3.0,4.0,Euro,surplus\n'
    (tmp_path / "s_odds.csv").write_text(text, encoding="utf-8")
    got = {r["home_raw"]: r for r in quotes.load_quotes(spark, f"{tmp_path}/*odds*.csv").filter("match_date < DATE '2024-07-09'").collect()}
    assert got['The "Reds"']["odds_home"] == 2.0 and got['The "Reds"']["odds_draw"] is None and got['The "Reds"']["competition"] is None
    assert got["Spain"]["competition"] == "Euro"


def test_ordered_operators_cross_small_buckets(spark):
    values = [None, "a", None, None, "b", None, None, None, None, "c", None]
    df = spark.createDataFrame([("f", i // 3, i, v) for i, v in enumerate(values)], "file string, chunk long, pos long, v string")
    numbered = ordered.number_rows(df, "file", "chunk", "pos")
    filled = ordered.fill_forward(numbered, "file", "ordinal", {"w": F.col("v")}, bucket_rows=2)
    assert [r["w"] for r in filled.orderBy("ordinal").collect()] == [None, "a", "a", "a", "b", "b", "b", "b", "b", "c", "c"]
    near = ordered.with_neighbours(numbered, "file", "ordinal", "pos", {"up": -2, "down": 3}, bucket_rows=4).orderBy("ordinal").collect()
    assert [r["up"] for r in near] == [None, None, *range(9)]
    assert [r["down"] for r in near] == [*range(3, 11), None, None, None]


def test_latest_before_crosses_buckets(spark):
    day = dt.date(2020, 1, 1)
    history = [(1, day + dt.timedelta(days=k), float(k), k) for k in (0, 5, 5, 400)]
    points = spark.createDataFrame([(u, d, v + i / 10, i) for i, (u, d, v, _) in enumerate(history)], "u int, at date, v double, i int")
    asked = spark.createDataFrame([(1, day + dt.timedelta(days=k)) for k in (-1, 0, 5, 300, 900)] + [(2, day)], "u int, at date")
    got = {(r["u"], (r["at"] - day).days): r["v"] for r in ordered.latest_before(asked, points, ["u"], "at", ["i"], "v").collect()}
    assert got == {(1, -1): None, (1, 0): 0.0, (1, 5): 5.2, (1, 300): 5.2, (1, 900): 400.3, (2, 0): None}


def test_links_first_per_page_with_text(spark):
    html = '<a href="/x/profil/spieler/7"><img></a><a class="q" href="/x/profil/spieler/7"> <b>Leo</b> </a><a href="/y/profil/spieler/7">L</a><a href="/z">Z</a>'
    got = pages.extract_links(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r["link"], r["text"]) for r in got] == [("7", "Leo")]


def test_sinks_round_trip(spark, tmp_path):
    first, second = spark.range(3), spark.range(5)
    path, backup = f"{tmp_path}/t", f"{tmp_path}/b"
    assert tables.replace_with_backup(first, path, backup) is False
    assert tables.replace_with_backup(second, path, backup) is True
    assert spark.read.parquet(path).count() == 5 and spark.read.option("header", True).csv(backup).count() == 3
    tables.write_queue(first, f"{tmp_path}/q")
    tables.write_queue(first.limit(0), f"{tmp_path}/q")
    assert spark.read.option("header", True).csv(f"{tmp_path}/q").count() == 0
    row = ((dict(friendly=0.3), 3650.0, 0.05, None), (0.9, 0.5, 10), (0.92, 0.5, 10), (42, 1, False), (-0.1, -0.2, 0.1, "within noise"))
    tables.write_proposal(spark.createDataFrame([row], schemas.PROPOSAL), f"{tmp_path}/p")
    assert tables.read_proposal(spark, f"{tmp_path}/p").first()["config"]["tiers"] == {"friendly": 0.3}


def test_ratings_reader_prunes_and_casts(spark, tmp_path):
    wide = {n: "1" for n in schemas.RATINGS_SOURCE.names} | {"value_eur": "", "pace": "99", "short_name": "L. Messi"}
    (tmp_path / "r.csv").write_text(",".join(wide) + "\n" + ",".join(wide.values()) + "\n")
    row = tables.read_ratings(spark, f"{tmp_path}/r.csv").first().asDict()
    assert "pace" not in row and row["value_eur"] is None and row["overall"] == 1 and row["short_name"] == "L. Messi"
    with pytest.raises(ValueError):
        tables.read_strings(spark, f"{tmp_path}/r.csv", ["absent"])


def test_rosters_stack_with_different_columns(spark):
    a = spark.createDataFrame([("1", "x")], "`No.` string, Player string")
    b = spark.createDataFrame([("y",)], "Player string")
    got = pages.stack_rosters([(a, "A", "Cup 1"), (b, "B", "Cup 1")]).orderBy("country").collect()
    assert [(r["country"], r["No."], r["Player"]) for r in got] == [("A", "1", "x"), ("B", None, "y")]
