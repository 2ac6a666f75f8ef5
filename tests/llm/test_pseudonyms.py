"""Pseudonyms: validity, permutation, linkage and untouched rest."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from fixtura.llm import pseudonyms as P
from fixtura.llm.queries import QUERIES

ADDRESS = re.compile(r"^(?:\d{1,3}\.){3}\d{1,3}$")


def _luhn(digits):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(v):
    d = re.sub(r"\D", "", v)
    if re.match(r"^\d{4}-\d\d-\d\d$|^\d{1,2}/\d{1,2}/\d{4}$", v):
        y, m, day = map(int, v.split("-")) if "-" in v else map(int, reversed(v.split("/")))
        try:
            return 1900 <= dt.date(y, m, day).year <= 2099
        except ValueError:
            return False
    if re.match(r"^\(\d{3}\) ?\d{3}-\d{4}$|^\d{3}-\d{3}-\d{4}$", v):
        return True
    if ADDRESS.match(v):
        return all(int(p) <= 255 for p in v.split("."))
    return bool(re.match(r"^\d{13,19}$|^\d{4}([ -]\d{4}){3}$", v)) and _luhn(d)


def _shape(v):
    return "address" if ADDRESS.match(v) else re.sub(r"\d+", "#", v) if "/" in v else re.sub(r"\d", "#", v)


def _pages(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in texts], "tournament_id long, page_text string, found string")


def test_permutations_are_whole(spark):
    n = P.DAYS[0] * P.DAYS[1]
    moved = spark.range(n).select(P.permuted_number(F.col("id"), P.DAYS, "k", "t").alias("m"))
    assert moved.agg(F.countDistinct("m"), F.min("m"), F.max("m")).first() == (n, 0, n - 1)
    digits = spark.range(10_000).select(P.permuted_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("m"))
    assert digits.where("m rlike '^[0-9]{4}$'").distinct().count() == 10_000
    single = spark.range(10).select(P.permuted_digits(F.col("id").cast("string"), "k", "t").alias("m"))
    assert single.distinct().count() == 10
    assert n == (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def test_every_candidate_follows_the_rule(spark):
    rng = random.Random(2)
    values = [f"{rng.randrange(10**15):015d}" for _ in range(12)]
    values = [v + next(str(c) for c in range(10) if _luhn(v + str(c))) for v in values[:6]] + [v + "0" for v in values[6:]]
    values += ["4539 5787 6362 1486", "4539-5787-6362-1486", "(017) 555-7713", "017-555-7713", "129.38.82.176", "0.0.0.0", "300.1.1.1", "1990-05-17", "2021-02-30", "1899-12-31", "7/5/1990", "17/05/1990", "31/4/2000"]
    rows = list(enumerate(f"before {v}, after {v}." for v in values))
    rows += [(100, None), (100, ""), (None, "no numbers 12 1234 12345678901234567890123"), (101, "1.2.3.4.5 and 12-1990-05-17"), (102, "x" * 100_000 + " 1990-05-17")]
    got = {(str(r.tournament_id), i): r for i, r in enumerate(P.pseudonymise_pages(_pages(spark, rows), "k").collect())}
    assert len(got) == len(rows)
    for (k, text), r in zip(rows, got.values()):
        if k is None or k >= 100:
            assert (r.page_text == text) == (k != 102) and r.n_replaced == (k == 102)
            continue
        v = values[k]
        a, b = re.fullmatch(r"before (.*), after (.*)\.", r.page_text).groups()
        assert a == b and _shape(a) == _shape(v)
        assert (valid(a) and a != v and r.n_replaced == 2) if valid(v) else (a == v and r.n_replaced == 0)
        if len(v) == 16 and valid(v):
            assert a[0] == v[0]


def test_key_decides_and_links(spark):
    pages = _pages(spark, [(1, "1990-05-17"), (2, "born 1990-05-17")])
    one, two = (P.pseudonymise_pages(pages, k).orderBy("tournament_id").collect() for k in "ab")
    assert one[1].page_text == "born " + one[0].page_text and one[0].page_text != two[0].page_text
    assert P.pseudonymise_pages(pages.limit(0), "a").count() == 0


def test_player_records(spark):
    players = spark.createDataFrame(
        [("P", dt.date(1990, 5, 17), "12345", 777, "1990-05-17"), ("Q", None, None, None, None), ("R", dt.date(1850, 1, 1), "no-id", 5, "7")],
        "player_name string, date_of_birth date, transfermarkt_player_id string, sofifa_player_id int, made string",
    )
    got = P.pseudonymise_players(players, "k").collect()
    assert got[0].date_of_birth != dt.date(1990, 5, 17) and re.match(r"^1\d{4}$", got[0].transfermarkt_player_id) and 700 <= got[0].sofifa_player_id <= 799
    assert tuple(got[1])[1:] == (None,) * 4 and got[2] == ("R", dt.date(1850, 1, 1), "no-id", 5, "7")
    text = P.pseudonymise_pages(_pages(spark, [(1, "1990-05-17")]), "k").first().page_text
    assert text == got[0].date_of_birth.isoformat()


def test_query_changes_valid_numbers_and_nothing_else(spark, sf_dir):
    finder = re.compile(P.CANDIDATE)
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    seen = {}
    for r in QUERIES["op9_pseudonyms"](spark, sf_dir).collect():
        old, new = finder.findall(given[r.doc_id]), finder.findall(r.text)
        assert finder.split(given[r.doc_id]) == finder.split(r.text) and r.n_replaced == sum(a != b for a, b in zip(old, new))
        for a, b in zip(old, new):
            assert (a != b) == valid(a) and seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_common_forms(spark):
    forms = [
        ("+1-555-123-4567", r"\+1-\d{3}-\d{3}-\d{4}"), ("1-800-555-1234", r"1-\d{3}-\d{3}-\d{4}"), ("555.123.4567", r"\d{3}\.\d{3}\.\d{4}"),
        ("555 123 4567", r"\d{3} \d{3} \d{4}"), ("+1 (743) 555-3824", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("+1(743) 555-3824", r"\+1\(\d{3}\) \d{3}-\d{4}"),
        ("+15551234567", r"\+1\d{10}"), ("0044-555-123-4567", r"0044-\d{3}-\d{3}-\d{4}"), ("10.0.0.1/24", r"[\d.]+/24"), ("10.0.0.1-10.0.0.9", r"[\d.]+-[\d.]+"),
        ("2001-02-03/2001-02-04", r"\d{4}-\d\d-\d\d/\d{4}-\d\d-\d\d"), ("3782 822463 10005", r"3\d{3} \d{6} \d{5}"), ("12/25/1990", r"\d\d/(1[3-9]|2\d|3[01])/\d{4}"),
        ("1/25/1990-13/2/1990", r"\d+/(1[3-9]|2\d|3[01])/\d{4}-\d+/\d+/\d{4}"),
    ]
    kept = ["12/32/1990", "13/13/1990", "300.1.1.1/24", "1-2-555-123-4567", "3782 822463 10006", "555-123-45678"]
    texts = [f"x {v}, y" for v, _ in forms] + [f"x {v}, y" for v in kept] + ["10.0.0.1 10.0.0.9 2001-02-03 2001-02-04"]
    got = [(r.page_text, r.n_replaced) for r in P.pseudonymise_pages(_pages(spark, enumerate(texts)).coalesce(1), "k").collect()]
    for (v, form), (text, n) in zip(forms, got):
        assert re.fullmatch(f"x {form}, y", text) and v not in text, (v, text)
        assert n == (2 if re.search(r"\d-\d+\.|\d/2001-|1990-", v) else 1), (v, text, n)
    assert [t for t, _ in got[len(forms) : -1]] == [f"x {v}, y" for v in kept]
    assert _luhn(re.sub(r"\D", "", got[11][0]))
    a, b, c, d = got[-1][0].split()
    assert got[8][0] == f"x {a}/24, y" and got[9][0] == f"x {a}-{b}, y" and got[10][0] == f"x {c}/{d}, y"


def test_month_first_dates_never_share_a_pseudonym(spark):
    days = spark.range(365 * 3).select(F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")).alias("d"))
    late = days.where(F.dayofmonth("d") > 12).select(F.date_format("d", "MM/dd/yyyy").alias("v"))
    every = late.union(days.select(F.date_format("d", "dd/MM/yyyy"))).select("v", P.date_text(F.col("v"), "k").alias("m"))
    n, different, wrong = every.agg(F.count("m"), F.countDistinct("m"), F.count_if((F.substring("v", 4, 2).cast("int") > 12) != (F.substring("m", 4, 2).cast("int") > 12))).first()
    assert n == different and wrong == 0
