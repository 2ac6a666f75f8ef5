"""Phrase and proximity matches against plain Python."""

import re

from fixtura.llm import leaks
from fixtura.llm.queries import CHECKS, QUERIES
from workload.compare import differences

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute(pages, items, size):
    windows = {}
    for name, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for key, text in pages:
        w, hit, names = _words(text), set(), set()
        for run, owners in windows.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    names |= owners
        out.append((key, len(w), len(hit), sorted(n for n in names if n is not None)))
    return out


def _check(spark, pages, items, size):
    p = spark.createDataFrame([(k, t, "x", 0) for k, t in pages], "tournament_id long, page_text string, wiki_page string, n_hit int")
    h = spark.createDataFrame([(k, t, 1) for k, t in items], "wiki_page string, page_text string, t1 int")
    got = [tuple(r) for r in leaks.find_leaks(p, h, size).collect()]
    assert sorted(got, key=str) == sorted(brute(pages, items, size), key=str)


PAGES = [
    (1, "The Big, red FOX runs over the big red fox runs"), (2, "big red"), (3, ""), (None, "the big red fox"), (4, None),
    (4, "the big red fox"), (5, "É é l'été a b a b a b a b"), (6, "nul\x00byte here; x" + " pad" * 30_000 + " the big red fox runs"), (7, "..."),
]
ITEMS = [("A", "the big red fox runs"), ("B", "big RED"), ("C", ""), ("D", None), (None, "fox runs over"), ("E", "é l été a"), ("F", "a b a b a"), ("B", "nul byte"), ("G", "nowhere to be found at all")]


def test_windows_hits_and_names(spark):
    for size in (3, 4, 10):
        _check(spark, PAGES, ITEMS, size)


def test_probe_table_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PROBE_ROWS", 0)
    _check(spark, PAGES, ITEMS, 4)


def test_empty_tables(spark):
    _check(spark, PAGES, [], 4)
    _check(spark, [], ITEMS, 4)


def test_proximity_adds_displaced_terms(spark):
    pages = spark.createDataFrame([(1, "alpha filler beta gamma"), (2, "alpha beta gamma"), (3, "alpha x y z beta")], "tournament_id long, page_text string")
    held = spark.createDataFrame([("A", "alpha beta gamma")], "wiki_page string, page_text string")
    assert [tuple(r) for r in leaks.find_matches(pages, held, 3, slop=0).collect()] == [(2, "A", "phrase", 0, 3)]
    assert sorted(r.kind for r in leaks.find_matches(pages, held, 3, slop=1).collect()) == ["phrase", "proximity"]


def test_matches_of_odd_rows(spark):
    schema = "tournament_id long, page_text string, wid int, place string"
    rows = [(1, "big red fox", 0, "x"), (1, "big red fox", 0, "x"), (None, "big red fox", 0, "x"), (2, None, 0, "x"), (3, "", 0, "x")]
    pages = spark.createDataFrame(rows, schema)
    held = spark.createDataFrame([("A", "big red", 1), (None, "big red", 1), ("A", "big red", 1), ("B", None, 1), ("C", "", 1)], "wiki_page string, page_text string, t1 int")
    got = sorted((tuple(r) for r in leaks.find_matches(pages, held, 10, 3).collect()), key=str)
    assert got == sorted(((k, n, "phrase", 0, 2) for k in (1, 1, None) for n in ("A", None)), key=str)
    assert leaks.find_matches(pages.limit(0), held).count() == 0 and leaks.find_matches(pages, held.limit(0)).count() == 0


def test_items_that_share_windows(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = [("A", long), ("B", f"zero {long}"), ("C", f"{long} thirteen"), ("D", long)]
    _check(spark, [(1, f"x {long} y"), (2, f"zero {long} thirteen"), (3, long.replace("six", "6")), (4, f"{long} {long}")], items, 5)


def brute_near(pages, items, size, slop):
    """Without the choice among neighbours: {(key, name, kind, start, len)} and all places in proximity."""
    phrases, near = set(), set()
    for key, text in pages:
        w = _words(text)
        for name, item in items:
            v = _words(item)
            for run in {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1) if v else 0)}:
                for s in range(1 - len(run), len(w)):
                    if s >= 0 and tuple(w[s : s + len(run)]) == run:
                        phrases.add((key, name, run, s))
                    missing = sum(x not in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, x in enumerate(run))
                    if missing <= len(run) // leaks.MISSING_OF and any(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(run)):
                        near.add((key, name, run, s))
    return phrases, near


def test_matches_with_replaced_and_displaced_words(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [
        f"pad pad {item} pad", f"pad {item.replace('four', 'other')} pad", f"x {item.replace('six', 'other').replace('two', 'more')}",
        item.replace("one two ", ""), "two one four three five six filler seven eight nine ten", item.replace("two", "a").replace("six", "b").replace("ten", "c"),
        "q " * 9 + item.replace(" nine ten", ""), "nothing of it", None, f"{item.replace('four', 'other')} {item.replace('nine', 'other')}",
    ]
    for unseen in (True, False):
        pages = [(i, t.replace("eight", "unseen") if t and unseen else t) for i, t in enumerate(texts)]
        p, h = spark.createDataFrame(pages, "tournament_id long, page_text string"), spark.createDataFrame([("A", item), ("B", "pad")], "wiki_page string, page_text string")
        got = [tuple(r) for r in leaks.find_matches(p, h, 10, 2).collect()]
        phrases, near = brute_near(pages, [("A", item), ("B", "pad")], 10, 2)
        assert {(k, n, s) for k, n, kind, s, _ in got if kind == "phrase"} == {(k, n, s) for k, n, _, s in phrases}
        assert len(got) == len(set(got)) and {(k, n) for k, n, *_ in got} == {(k, n) for k, n, *_ in near}
        assert {(k, n, s) for k, n, kind, s, _ in got if kind == "proximity"} <= {(k, n, max(0, s)) for k, n, _, s in near}
        for k, n, _, s in near:
            if n == "A":
                assert any((k, n) == g[:2] and abs(g[3] - max(0, s)) <= 10 for g in got)
        lengths = {k: len(_words(t)) for k, t in pages}
        assert all(s >= 0 and 0 < m <= 10 and s + m <= lengths[k] for k, _, _, s, m in got)
    assert {k for k, n, *_ in got if n == "A"} == {0, 1, 2, 3, 4, 6, 9}
    assert (3, "A", "proximity", 0, 8) in got and (1, "A", "proximity", 1, 10) in got and (6, "A", "proximity", 9, 8) in got


def test_rows_with_leaks_go(spark):
    docs = spark.createDataFrame([(1, "the big red fox runs", "t1"), (None, "clean text", "t2"), (2, None, None)], "doc_id long, text string, t1 string")
    items = spark.createDataFrame([("A", "big red fox")], "wiki_page string, page_text string")
    assert sorted(map(str, leaks.without_leaks(docs, "text", items).collect())) == sorted(map(str, docs.where("NOT doc_id <=> 1").collect()))


def test_no_leaks_in_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "big red fox", "x"), (1, "big red fox", "x"), (2, "clean", "x"), (2, "clean", "x")], "doc_id long, text string, t2 string")
    items = spark.createDataFrame([("A", "big red fox")], "wiki_page string, page_text string")
    assert [tuple(r) for r in leaks.without_leaks(docs, "text", items).collect()] == [(2, "clean", "x")] * 2
    assert leaks.without_leaks(docs, "text", items.limit(0)).count() == 4 and leaks.without_leaks(docs.limit(0), "text", items).count() == 0


def test_query_matches_sql(spark, sf_dir):
    name = "op8_decontamination"
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), CHECKS[name], sf_dir) is None
