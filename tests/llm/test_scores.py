"""Toxicity, quality and language: held-out accuracy on the given tables, and the arithmetic against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtura.llm import languages, quality, toxicity
from fixtura.llm.queries import QUERIES
from fixtura.llm.text import letter_stream

SF = "/root/testdata/sf0.01"


def _auc(pairs):
    pairs = sorted(pairs)
    ranks = np.arange(1, len(pairs) + 1)
    y = np.array([l for _, l in pairs])
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name,label,auc,threshold", [("op1_toxicity", "toxic", 0.9, 0.7), ("op4_quality", "quality", 0.97, 0.5)])
def test_held_out_labels(spark, name, label, auc, threshold):
    got = QUERIES[name](spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    assert _auc([(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]) > auc


def test_held_out_languages(spark):
    got = QUERIES["op10_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in got)


def _pages(spark, texts):
    return spark.createDataFrame([(k, t, 0.5, "x") for k, t in texts], "tournament_id long, page_text string, score double, label string")


ODD = [(1, None), (1, ""), (None, "plain words of a page"), (2, "word " * 40_000), (3, "!!! ... 123"), (4, "漢字 と かな"), (4, "漢字 と かな")]


def test_scores_of_odd_rows(spark):
    rng = random.Random(1)
    clean = ["the match was won by the home side", "a fine pass and a goal", "rain fell on the ground"]
    texts = [(i, " ".join(rng.choices(clean, k=4)) + (" you rotten idiot" if i % 4 == 0 else "")) for i in range(10, 130)]
    judged = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0), "z") for i, _ in texts] + [(None, 1, 1, "z"), (10, None, None, "z"), (10, 7, 7, "z")], "tournament_id long, toxic int, quality int, page_text string")
    for score, low in ((toxicity.score_pages, 0), (quality.score_quality, 1)):
        got = score(_pages(spark, texts + ODD), judged).collect()
        assert sorted(str(r.tournament_id) for r in got) == sorted(str(k) for k, _ in texts + ODD)
        assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
        same = [r.score for r in got if r.tournament_id == 4]
        assert same[0] == same[1]
        assert score(_pages(spark, texts).limit(0), judged).count() == 0
        assert score(_pages(spark, ODD), judged.limit(0)).count() == len(ODD)
    found = {r.tournament_id: r.score for r in toxicity.score_pages(_pages(spark, texts), judged).collect()}
    assert all((found[i] > 0.7) == (i % 4 == 0) for i, _ in texts)


def test_document_counts_match_plain_ngrams():
    texts = ["Ab  cde f", "", "ab cdé f" * 30]
    got = [set() for _ in texts]
    for own, bucket in toxicity._buckets(texts):
        for o, b in zip(own.tolist(), bucket.tolist()):
            got[o].add(b)
    named = {}
    for i, t in enumerate(texts):
        points, _ = letter_stream([t])
        s = "".join(map(chr, points))
        grams = {s[a : a + n] for n in toxicity.ORDERS for a in range(len(s) - n + 1)}
        assert len(got[i]) <= len(grams) and (len(got[i]) == len(grams) or len(grams) > 50)
        for b in got[i]:
            named.setdefault(b, set()).add(i)
    assert got[1] == set()


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d = 4
    x = rng.normal(size=(30, d))
    directions, phases = rng.normal(size=(d, quality.N_FEATURES)), rng.uniform(0, 2 * np.pi, quality.N_FEATURES)
    model = quality.QualityModel(np.zeros(d), np.ones(d), directions, phases, None, None, None)
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    assert np.abs(z @ z.T - exact).max() < 0.3 and np.abs(z @ z.T - exact).mean() < 0.06


def test_ridge_matches_one_machine(spark):
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x, y = rng.normal(size=(200, d)), rng.integers(0, 2, 200)
    model = quality.QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, quality.N_FEATURES)) / 6, rng.uniform(0, 6, quality.N_FEATURES), None, None, None)
    rows = spark.createDataFrame([(v.tolist(), int(l)) for v, l in zip(x, y)], "stats array<double>, label int").repartition(5)
    z = model.features(x)
    penalty = np.eye(z.shape[1]) * quality.RIDGE * len(x)
    penalty[-1, -1] = 1e-9
    want = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(quality._ridge(rows, model), want, atol=1e-6)


def test_pool_adjacent_is_monotone_and_optimal():
    assert quality.pool_adjacent(np.array([1.0, 3, 2, 2, 5]), np.array([1.0, 1, 1, 2, 1])).tolist() == [1, 2.25, 2.25, 2.25, 5]
    assert quality.pool_adjacent(np.array([]), np.array([])).tolist() == []


def test_statistics_of_known_texts():
    names = quality.STATISTICS
    rows = [dict(zip(names, r)) for r in quality.statistics(["aa bb aa aa", "", "A1| x!!\ny"])]
    assert rows[0]["distinct_words"] == 0.5 and rows[0]["same_word_next"] == 0.25 and rows[0]["distinct_fours"] == 1
    assert rows[1]["empty"] == 1 and rows[1]["log_chars"] == 0
    assert rows[2]["upper"] == 1 / 9 and rows[2]["pipes"] == 1 / 9 and rows[2]["odd_endings"] == 2 / 3 and rows[2]["line_breaks"] == 1 / 9


def _phrases(text, training):
    """Greedy cross-parsing by substring search."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i : i + size + 1] in training:
            size += 1
        i += size
        n += 1
    return n


def _stream(text):
    points, _ = letter_stream([text])
    return "".join(map(chr, points))


def test_phrase_counts_match_substring_search(monkeypatch):
    monkeypatch.setattr(languages, "LANE", 17)
    rng = random.Random(4)
    words = ["goal", "gol", "tor", "but", "ñandú", "x"]
    samples = languages.Samples(("a", "b"), (" ".join(rng.choices(words[:3], k=30)), " ".join(rng.choices(words[2:], k=30))), " abdglnorstuxúñ")
    texts = [" ".join(rng.choices(words + ["zzz", "漢"], k=rng.randrange(0, 12))) for _ in range(40)] + ["", "q"]
    counts, sizes = languages.phrase_counts(texts, samples)
    known = set(samples.alphabet)
    for j, training in enumerate(samples.texts):
        for i, t in enumerate(texts):
            s = "".join(c if c in known else "\0" for c in _stream(t))
            lanes = [s[a : a + 17] for a in range(0, len(s), 17)]
            assert counts[j][i] == sum(_phrases(x, _stream(training)) for x in lanes) and sizes[i] == len(s)


def test_names_of_odd_rows(spark):
    known = spark.createDataFrame([("Juan Pablo Ñandú", "ES"), ("Hans Müller", "DE"), ("Pedro Alba", "ES"), ("Nobody", None), (None, "FR"), ("123", "XX")], "long_name string, nationality_name string")
    rows = [(1, "Juan Alba"), (2, "Hans Hans"), (None, "Müller"), (3, None), (4, ""), (5, "12 !?"), (2, "Hans Hans")]
    df = spark.createDataFrame([(k, t, "q", 1.0) for k, t in rows], "player_id long, long_name string, label string, score double")
    got = {str(r.player_id): (r.nationality_pred, r.score) for r in languages.predict_nationality(df, known).collect()}
    assert got["1"][0] == "ES" and got["2"][0] == "DE" and got["None"][0] == "DE"
    assert got["3"] == got["4"] == got["5"] == ("und", 0.0)
    assert {r.nationality_pred for r in languages.predict_nationality(df, known.limit(0)).collect()} == {"und"}
    assert languages.predict_nationality(df.limit(0), known).count() == 0
    one = languages.predict_nationality(df, known.where("nationality_name = 'DE'")).where(F.col("player_id") == 1).first()
    assert (one.nationality_pred, one.score) == ("DE", 1.0)


def test_training_text_is_bounded(spark):
    rows = [("wort " * 20, "DE")] * 50 + [("word " * 5_000, "EN"), ("short name", "EN")]
    samples = languages.training_samples(spark.createDataFrame(rows, "t string, l string"), "t", "l", 800)
    assert samples.labels == ("DE", "EN") and samples.texts[1] == "short name" and all(len(t) <= 800 for t in samples.texts)
    assert math.isclose(len(samples.texts[0]), 100, abs_tol=1)


def test_every_label_with_letters_is_learnt(spark, monkeypatch):
    copies = spark.range(100_000).select(F.concat(F.lit("one text of "), (F.col("id") % 5).cast("string")).alias("t"), F.concat(F.lit("copied"), (F.col("id") % 5).cast("string")).alias("l"))
    rows = [("long words " * 500 + f"end {i}", "long") for i in range(3)] + [("1" * 999 + "x", "late"), ("123", "none"), (None, "null"), ("a", None)]
    known = copies.union(spark.createDataFrame(rows, "t string, l string"))
    samples = languages.training_samples(known, "t", "l", 800)
    labels = (*[f"copied{i}" for i in range(5)], "late", "long")
    assert samples.labels == labels and samples.texts[0] == "one text of 0" and samples.texts[5] == "x"
    assert 400 <= len(samples.texts[6]) <= 802
    many = spark.range(5_000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"), F.lit("many").alias("l"))
    hashes = sorted((r.h, r.t) for r in many.select("t", F.xxhash64("t").alias("h")).collect())[: languages.CANDIDATES]
    assert languages.training_samples(many, "t", "l").texts == (" ".join(t for _, t in hashes),)
    monkeypatch.setattr(languages, "CELLS", 2_000)
    tight = languages.training_samples(known, "t", "l", 800)
    assert tight.labels == labels and all(any(map(str.isalpha, t)) for t in tight.texts)
    monkeypatch.setattr(languages, "CELLS", 100)
    with pytest.raises(ValueError):
        languages.training_samples(known, "t", "l", 800)
