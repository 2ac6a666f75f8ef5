"""N-gram join against comparison of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fixtura.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(w) >= size:
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def brute(rows, size=jaccard.WORDS, percent=jaccard.PERCENT):
    """Per row position: (set size, component, links)."""
    sets = [_set(t, size) for _, t in rows]
    group, links = {i: i for i in range(len(rows))}, [0] * len(rows)

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    links[i] += 1
                    links[j] += 1
                    group[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(len(sets[i]), least[root(i)] if rows[i][0] is not None else None, links[i]) for i in range(len(rows))]


def _check(spark, rows, **args):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "tournament_id long, page_text string, n string, cid int")
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in jaccard.page_copies(df, **args).collect())
    assert got == sorted((str(k), n, str(c), m) for (k, _), (n, c, m) in zip(rows, brute(rows, **args)))


def _varied(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    return " ".join(w)


def _family_rows(rng, sizes, length):
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        rows += [_varied(rng, base, rng.randrange(0, 6)) for _ in range(size)]
    rng.shuffle(rows)
    return rows


def test_families_copies_and_edges_of_the_threshold(spark):
    rng = random.Random(5)
    texts = _family_rows(rng, [1] * 20 + [2, 3, 5, 12], 90)
    texts += [texts[0]] * 9 + [texts[1].upper(), "  " + texts[2].replace(" ", "\n\t") + " "]
    texts += ["", None, " \n", "one two", "One two", "one two three", "a b c d", "a b c d", "word " * 3000, "x" * 50_000]
    rows = [(100 + 7 * i % 911, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (100, "one two"), (100, texts[3])]
    _check(spark, rows)


def test_common_grams_and_blocks(spark, monkeypatch):
    """Small bounds send families through common grams and through several blocks; links stay the same."""
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = _family_rows(rng, [40, 18], 60) + [f"{passage} {t}" for t in _family_rows(rng, [1] * 15 + [3], 20)] + [passage] * 3
    _check(spark, list(enumerate(texts)))
    _check(spark, list(enumerate(texts)), size=3, percent=60)


def test_empty_table(spark):
    df = spark.createDataFrame([], "tournament_id long, page_text string")
    assert jaccard.page_copies(df).collect() == []


def test_overlaps_count_common_elements(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "COLUMNS", 3)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, n)) for n in (1, 5, 20, 25, 2)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard.overlaps(sets)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(5, " ".join(base), "a"), (3, _varied(rng, base, 1), "b"), (3, "other text of five words", "c"), (9, "alone again", "d")]
    rows += [(9, "alone again", "e"), (None, " ".join(base), "f"), (11, "", "g"), (11, None, "h"), (12, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = jaccard.keep_one_of_copies(df, "doc_id", "text").collect()
    assert sorted(r.component for r in kept if r.doc_id not in (9, 11)) == ["b", "c", "f", "i"]
    assert sum(r.doc_id == 9 for r in kept) == 1 and sum(r.doc_id == 11 for r in kept) == 2 and kept[0].__fields__ == df.columns


@pytest.mark.parametrize("query", ["op2_ngram_jaccard"])
def test_query_matches_all_pairs(spark, sf_dir, query):
    from fixtura.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in QUERIES[query](spark, sf_dir).select(F.col("*")).collect()}
    assert got == {k: v for (k, _), v in zip(docs, brute(docs))}


def test_whole_sets_are_not_moved_to_be_told_apart(spark, monkeypatch):
    plans, keep = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or keep(df))
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(_family_rows(rng, [2, 3, 4], 60))]
    _check(spark, rows)
    made = [plan for columns, plan in plans if columns == ["cid", "n", "copies", "grams", "at"]]
    assert len(made) == 1 and not re.search(r"Exchange hashpartitioning\((cid|n)#", made[0])
    plans.clear()
    _check(spark, rows + rows[:5])
    assert len([1 for columns, _ in plans if columns == ["cid", "n", "copies", "grams", "at"]]) == 2


@pytest.mark.parametrize("percent", [80, 85])
def test_long_sets_of_lone_grams_go_no_further(spark, percent):
    """More grams are counted than a partner may lack, so long pages that share nothing are sorted out; copies stay."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(900)) for _ in range(6)]
    texts.append(texts[0].rsplit(" ", 3)[0])
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, page_text string")
    rows = df.select("uid", jaccard._described(5, percent, whole=False)("page_text").alias("d")).select("uid", "d.*")
    classes = rows.select(F.col("uid").alias("cid"), F.col("uid").alias("key"), "n", "s1", "s2", F.lit(1).alias("copies"))
    assert {r.cid for r in jaccard._reachable(classes, rows, percent).collect()} == {0, 6}
