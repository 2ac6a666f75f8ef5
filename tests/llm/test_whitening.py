"""Whitening on exact components against plain linear algebra."""

import numpy as np
import pytest

from fixtura.llm import whitening as W
from fixtura.llm.queries import QUERIES


def reference(vectors, most=16):
    """(n, S, deviations, eigenvalues, axes) of whole-number rows by numpy."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1][:most], axes[:, ::-1][:, :most]


def agrees(got, ids, vectors):
    x, fit, values, axes = reference(vectors)
    n, sums = len(fit), fit.sum(axis=0)
    got = got.sort_values([got.columns[0], "component"])
    k = got["component"].max()
    z = got["whitened"].to_numpy().reshape(-1, k)
    want = (x - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
    order = np.argsort(ids, kind="stable")
    want, z = want[order], z * np.sign((z * want[order]).sum(axis=0))
    assert np.allclose(z, want, atol=1e-6)
    assert (got["n"] == n).all()
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, sums)) for row in x[order]]
    assert [int(v) for v in got["deviation"].to_numpy().reshape(-1, k)[:, 0]] == deviation
    trace = sum(np.linalg.eigvalsh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1)))
    assert np.allclose(got["explained"].to_numpy().reshape(-1, k)[0], values[:k] / trace, rtol=1e-6)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_plain_linear_algebra(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    got = QUERIES["op12_whitening"](spark, f"/root/testdata/{sf}")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.toPandas()
    assert len(got) == 16 * len(rows)
    agrees(got, rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()))


def test_characteristic_polynomial_is_exact():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 6):
        a = rng.integers(-50, 50, (d, d))
        a = (a @ a.T).astype(object)
        if d == 6:
            a[2], a[:, 2] = 0, 0
        primes = np.array(W.primes_below(1 << 31, 1 << 120))
        got = W.characteristic_residues(a, primes)
        # Newton's identities in exact integers.
        power, traces = np.eye(d, dtype=int).astype(object), []
        for _ in range(d):
            power = power @ a
            traces.append(int(np.trace(power)))
        e = [1]
        for k in range(1, d + 1):
            e.append(sum((-1) ** (i - 1) * e[k - i] * traces[i - 1] for i in range(1, k + 1)) // k)
        want = [(-1) ** k * e[k] for k in range(d + 1)][::-1]
        assert all([w % int(p) for w in want] == list(row) for row, p in zip(got, primes))


def test_roots_counted_and_isolated():
    # (t - 1) (t - 4)^2 (t - 9) (t - 0)
    coefficients = [int(c) for c in np.poly([1, 4, 4, 9, 0]).round()]
    assert [W.roots_above(coefficients, a) for a in (-1, 0, 1, 3, 4, 9)] == [5, 4, 3, 3, 1, 0]
    assert [W.isolated_root(coefficients, k, 20) for k in range(1, 6)] == [(9, 1, 1), (4, 2, 3), (4, 2, 3), (1, 4, 4), (0, 5, 5)]


def test_gram_of_large_entries_is_exact():
    rows = np.array([[1 << 48, -(1 << 48), 3], [-(1 << 48), 5, (1 << 40) + 7], [1, 2, 3]], np.int64)
    assert (W.exact_gram(rows) == rows.astype(object).T @ rows.astype(object)).all()


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [rng.normal(size=4).tolist() for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (100, good[3]), (None, good[4])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("-inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows + bad], "player_id long, attributes array<double>, component int, n string")
    got = W.whiten_players(df)
    assert got.count() == 4 * len(rows) and got.where("player_id >= 200").count() == 0
    got = got.toPandas()
    got["player_id"] = got["player_id"].fillna(-1)
    kept = got[got.component == 1].sort_values("player_id")
    assert kept["player_id"].tolist() == sorted([-1 if k is None else k for k, _ in rows])
    unique = got.drop_duplicates(["player_id", "component"])
    order = sorted({-1 if k is None else k: v for k, v in rows}.items())
    agrees(unique, np.array([k for k, _ in order]), [v for _, v in order])
    for few in (df.limit(0), df.where("player_id >= 200 AND player_id < 205"), df.where("player_id IN (3, 100)")):
        assert W.whiten_players(few).count() == 0


def test_equal_eigenvalues_huge_entries_and_missing_rank(spark):
    # A cross in the plane: two equal eigenvalues, and a third dimension without variance.
    cross = [(1, [1.0, 0.0, 5.0]), (2, [-1.0, 0.0, 5.0]), (3, [0.0, 1.0, 5.0]), (4, [0.0, -1.0, 5.0])]
    df = spark.createDataFrame(cross, "player_id long, attributes array<double>")
    got = W.whiten_players(df).toPandas()
    assert len(got) == 8 and np.allclose(got.explained, 0.5) and got.identity_error.max() < 1e-12
    z = got.sort_values(["player_id", "component"]).whitened.to_numpy().reshape(4, 2)
    assert np.allclose(z.T @ z / 4, np.eye(2))
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 3.0])], "player_id long, attributes array<double>")
    got = W.whiten_players(huge).toPandas()
    assert len(got) == 6 and got.identity_error.max() < 1e-6
    n, s = 3, [0, 256]
    want = sum((n * int(v) - t) ** 2 for v, t in zip((1 << 48, 0), s))
    assert int(got[got.player_id == 1].deviation.iloc[0]) == want
