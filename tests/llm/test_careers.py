"""Prefix trie of careers against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtura.llm import careers as C
from fixtura.llm.queries import QUERIES

APPEARANCE = "sofifa_player_id long, year int, position string, club string"


def brute(sequences):
    """{(player, depth): row} of (player, list of (position, club)) pairs, one prefix at a time."""
    members = {}
    for player, steps in sequences:
        for d in range(len(steps) + 1):
            members.setdefault(tuple(steps[:d]), []).append((player, len(steps) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(player for player, ends in own if ends)
        rows.append((
            min(x for x, _ in own), len(p), min(x for x, _ in members[p[:-1]]) if p else None, len(own), len(kids.get(p, [])),
            sum(q not in kids for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*C._RESULT).collect()), key=repr)


def random_careers(seed, n=120):
    rng = random.Random(seed)
    out = []
    for player in range(n):
        length = rng.choice([0, 1, 1, 2, 3, 5, 9])
        out.append((player * 3 - 40, [(rng.choice(["GK", "FW"]), rng.choice(["Ajax", "Gent", "1. FC Köln"][: 1 + d % 3])) for d in range(length)]))
    return out


def career_rows(spark, sequences):
    """Rows of ``careers``, careers without a step included."""
    steps = spark.createDataFrame([(p, 1990 + i, a, b) for p, s in sequences for i, (a, b) in enumerate(s)], APPEARANCE)
    empty = spark.createDataFrame([(p,) for p, s in sequences if not s] or [(0,)], "sofifa_player_id long").where(F.lit(any(not s for _, s in sequences)))
    own = C.careers(steps)
    return own.unionByName(empty.select("sofifa_player_id", F.array().cast(own.schema["steps"].dataType).alias("steps")))


@pytest.mark.parametrize("run", [1 << 18, 7, 1])
def test_trie_equals_brute_force_whatever_the_runs(spark, run):
    if run < 100:
        # Runs end with their batch, so batches are small too.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, run // 3)))
    try:
        for seed in range(2):
            sequences = random_careers(seed)
            assert rows_of(C.career_trie(career_rows(spark, sequences), run)) == brute(sequences)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_extents_of_a_sparse_table():
    rng = np.random.default_rng(0)
    lcp = np.r_[-1, rng.integers(0, 4, 60)]
    table = C._minima(lcp)
    at, depth = (x.ravel() for x in np.meshgrid(np.arange(61), np.arange(5)))
    for a, d, left, right in zip(at, depth, C.left_extent(table, at, depth), C.right_extent(table, at, depth)):
        lo = hi = a
        while lo > 0 and lcp[lo] >= d:
            lo -= 1
        while hi < 60 and lcp[hi + 1] >= d:
            hi += 1
        assert (left, right) == (lo, hi)


def test_odd_rows(spark):
    rows = [
        (1, None, "GK", "Ajax"), (1, 1990, "FW", "Gent"), (1, 1990, "FW", "Gent"), (2, 1992, None, None), (2, 1990, "GK", "Ajax"),
        (3, 1990, "FW", ""), (3, 1990, "DF", "é" * 5000), (None, 1990, "FW", "Ajax"), (4, 5, "G", "KAjax"), (5, 1, "GK", "Ajax"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], APPEARANCE + ", steps string, depth int")
    want = [
        (1, [("GK", "Ajax"), ("FW", "Gent"), ("FW", "Gent")]), (2, [("GK", "Ajax"), ("", "")]),
        (3, [("DF", "é" * 5000), ("FW", "")]), (4, [("G", "KAjax")]), (5, [("GK", "Ajax")]),
    ]
    assert rows_of(C.career_trie(C.careers(df))) == brute(want)
    assert C.career_trie(C.careers(df.limit(0))).count() == 0


def test_a_player_that_repeats_counts_each_time(spark):
    own = C.careers(spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "a", "b")], APPEARANCE))
    got = rows_of(C.career_trie(own.union(own)))
    assert got == brute([(1, [("a", "b")]), (2, [("a", "b")])] * 2)


def test_query_equals_brute_force(spark, sf_dir):
    for source in (sf_dir, "/root/testdata/sf0.01"):
        own = {}
        for r in sorted(spark.read.parquet(f"{source}/conversations.parquet").collect(), key=lambda r: (r.turn is not None, r.turn)):
            own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
        rebuilt = []
        for c, s in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            rebuilt.append((c, own.get(c - c % 100, [])[:h] + s[h:]))
        got = QUERIES["op11_prefix_trie"](spark, source)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rebuilt)


def test_absent_donor_and_career_without_own_steps(spark):
    own = C.careers(spark.createDataFrame([(150, 1, "a", "b"), (260, 1, "a", "b"), (200, 1, "c", "d"), (200, 2, "e", "f")], APPEARANCE))
    got = {r.sofifa_player_id: len(r.steps) for r in C.with_borrowed_starts(own, F.expr("sofifa_player_id - sofifa_player_id % 100"), F.lit(3), 3).collect()}
    assert got == {150: 0, 260: 2, 200: 2}
