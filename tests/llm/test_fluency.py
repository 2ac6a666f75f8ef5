"""Recurrent language model: gradients, whole-document state, counts against brute force, and gain on held-out pages."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from fixtura.llm import fluency as L
from fixtura.llm import recurrent as R
from fixtura.llm.queries import QUERIES


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    words = np.r_[rng.integers(1, 9, 100), np.zeros(28)]
    p = R.fresh(words, np.r_[words.reshape(-1, R.CLASS_WORDS).sum(axis=1), [5.0, 3.0]])
    for k in ("classes", "words"):
        p[k] += rng.normal(0, 0.1, p[k].shape).astype(np.float32)
    return p


def texts(rng, count, longest):
    sizes = rng.integers(1, longest, count)
    return np.concatenate([np.r_[rng.choice(np.r_[1:100, 128:130], n - 1), R.END] for n in sizes]).astype(np.int32), sizes


def plain(p, tokens):
    """One text, one token at a time, in double precision."""
    p = {k: v.astype(float) for k, v in p.items()}
    h, last, out, n = np.zeros(R.STATE), R.END, 0.0, len(p["words"])
    for t in tokens:
        a, hw = p["embedding"][last] @ p["input"] + p["bias"], h @ p["recurrent"]
        g = (1 + np.tanh(a[: 2 * R.STATE] + hw[: 2 * R.STATE])) / 2
        r, z = g[: R.STATE], g[R.STATE :]
        new = np.tanh(a[2 * R.STATE :] + r * hw[2 * R.STATE :])
        h = new + z * (h - new)
        s = np.r_[h, 1]
        logits = s @ p["classes"]
        c = t // R.CLASS_WORDS if t < n else t - n + n // R.CLASS_WORDS
        out += logits[c] - np.log(np.exp(logits).sum())
        if t < n:
            rows = p["words"][c * R.CLASS_WORDS : (c + 1) * R.CLASS_WORDS] @ s
            out += rows[t % R.CLASS_WORDS] - np.log(np.exp(rows).sum())
        last = t
    return out


def test_whole_texts_carry_their_state_over_windows():
    p, rng = small_model(), np.random.default_rng(2)
    tokens, sizes = texts(rng, 30, 90)
    got = R.read(p, tokens, sizes)
    want = [plain(p, t) for t in np.split(tokens, np.cumsum(sizes)[:-1])]
    assert np.allclose(got, want, rtol=1e-4)


def test_gradient_equals_finite_differences(monkeypatch):
    p, rng = small_model(), np.random.default_rng(3)
    tokens, sizes = texts(rng, 6, 14)
    seen = {}
    monkeypatch.setattr(R, "_step", lambda p, steps, name, g, rows=slice(None): seen.update({name: (g.copy(), rows)}))
    R.read(p, tokens, sizes, R.fresh_steps(p))
    for name in p:
        g, rows = seen[name]
        full = np.zeros(p[name].shape)
        full[rows] = g
        for i in np.argsort(-np.abs(full).ravel())[:3]:
            at, eps, values = np.unravel_index(i, full.shape), 1e-2, []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += sign * eps
                values.append(sum(plain(q, t) for t in np.split(tokens, np.cumsum(sizes)[:-1])))
            assert np.isclose(-(values[0] - values[1]) / (2 * eps), full[at], rtol=0.03, atol=1e-3), name


def test_lanes_hold_each_token_once():
    sizes = np.random.default_rng(4).integers(1, 50, 200)
    lane, at = R.lanes(sizes, 7)
    cells = [(a, i) for a, s, n in zip(lane, at, sizes) for i in range(s, s + n)]
    assert len(set(cells)) == sizes.sum()
    length = np.bincount(lane, sizes, 7)
    assert (np.diff(length) <= 0).all()


def base_by_hand(rows):
    """{place: (n_tokens, n_known, N, base)} by the rule itself."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t, _ in rows]
    count = Counter(w for own, (_, _, learn) in zip(words, rows) if learn for w in own)
    total, kinds = sum(count.values()), len(count)
    return [
        (len(own), sum(count[w] > 0 for w in own), total, sum(log10((count[w] + 1) / (total + kinds + 1)) for w in own)) for own in words
    ]


def test_counts_and_gain_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_lm_scoring"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    held = []
    for (key, _, learn), (n, known, total, base) in zip(rows, base_by_hand(rows)):
        r = got[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn, n, known, total)
        assert np.isclose(r.base_score, base) and r.score < 0
        if not learn:
            held.append((r.score, base, n))
    score, base, n = np.sum(held, axis=0)
    assert (score - base) / n > 0.2


@pytest.mark.parametrize("counted", [1 << 18, 3, 0])
def test_odd_rows_and_words_that_are_not_broadcast(spark, monkeypatch, counted):
    monkeypatch.setattr(L, "COUNTED", counted)
    data = [
        (1, "The cat sat the", True), (1, "The cat sat the", True), (2, None, True), (3, "", False), (None, "ÉTÉ the unseen", False),
        (4, "x" * 300 + " the " + "w " * 5000, True), (5, "\t\n\x0b \x0c\r", False), (6, "cat\x1csat \x1f", None),
    ]
    df = spark.createDataFrame([(*r, 7, "n") for r in data], "tournament_id long, page_text string, own boolean, uid int, n string").coalesce(1)
    got = L.page_fluency(df, df["own"])
    assert got.columns == ["tournament_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = base_by_hand([(k, t, bool(own)) for k, t, own in data])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    rows = sorted(((r.tournament_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()), key=key)
    assert rows == sorted(((k, n, known, total, round(base, 6)) for (k, _, _), (n, known, total, base) in zip(data, want)), key=key)
    assert all(r.score <= 0 for r in got.collect())


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "tournament_id long, page_text string")
    rows = L.page_fluency(df, df["tournament_id"] < 0).collect()
    assert len(rows) == 2 and all(r.train_tokens == 0 and r.base_score == 0 and np.isfinite(r.score) for r in rows)
    assert L.page_fluency(df.limit(0), df["tournament_id"] > 0).count() == 0


def test_numbers_are_sorted_by_digits_where_they_fit():
    """Same stable order as of whole numbers, small or not, and none of nothing."""
    rng = np.random.default_rng(3)
    for top in (7, 1 << 15, 1 << 20):
        numbers = rng.integers(0, top, 5_000).astype(np.int32)
        assert (R._sorted(numbers) == np.argsort(numbers, kind="stable")).all()
    assert not len(R._sorted(np.zeros(0, np.int32)))


def test_gates_that_are_shut_tight_stay_finite():
    """Gates of any size give probabilities, without a warning."""
    counts = np.zeros(R.CLASS_WORDS)
    counts[:3] = 5
    p = R.fresh(counts, np.array([15.0, 1.0]))
    p["bias"][: 2 * R.STATE] = -500
    with np.errstate(all="raise", under="ignore"):
        found = R.read(p, np.array([1, 2, R.END, R.END], np.int32), np.array([3, 1]), width=2, time=2)
    assert np.isfinite(found).all() and (found < 0).all()
