"""Whitening of player attribute vectors on exact principal components.

Scatter sums are integers, so the characteristic polynomial of the scatter is found exactly: modulo many primes through
Hessenberg form, put together by Chinese remainders. Its real roots are isolated with integers alone, and each component
comes from the null space at its root by inverse iteration in fixed point. Vectors are summed and projected in Spark tasks,
primes and components are rows of their own; the driver holds what a dimension squared bounds.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from math import comb, isqrt, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.store import stored

COMPONENTS = 16
# Attributes are cut to whole multiples of 1 / STEPS, and those beyond FARTHEST / STEPS count as that.
STEPS = 64
FARTHEST = 1 << 48
# Bits of the largest root, and of fractions in fixed point.
ROOT_BITS = 160
FRACTION = 200
_LIMB = 18
_BLOCK = 1 << 16
_AXIS = "component int, eigenvalue double, explained double, axis array<double>"
_RESULT = "player_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def usable(attributes: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return attributes.isNotNull() & F.forall(attributes, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))), F.lit(False)))


def whole(attributes: Column) -> Column:
    """Entries as whole numbers of 1 / STEPS, rounded down."""
    limit = F.lit(FARTHEST)
    return F.transform(attributes, lambda v: F.greatest(-limit, F.least(limit, F.floor(v.cast("double") * STEPS))))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows as Python integers. Entries are split into limbs so short that floating point sums them exactly."""
    limbs, left = [], rows
    while (left < -(1 << _LIMB)).any() or (left >= 1 << _LIMB).any():
        limbs.append(left & ((1 << _LIMB) - 1))
        left = left >> _LIMB
    limbs.append(left)
    total = np.zeros((rows.shape[1],) * 2, object)
    for i, x in enumerate(limbs):
        for j, y in enumerate(limbs):
            for a in range(0, len(rows), _BLOCK):
                part = x[a : a + _BLOCK].astype(float).T @ y[a : a + _BLOCK].astype(float)
                total += part.astype(np.int64).astype(object) << _LIMB * (i + j)
    return total


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and sums of products over ``fit``; tasks hand on one sum per entry."""
    upper = np.triu_indices(d)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0))
                n, sums, gram = n + len(rows), sums + rows.astype(object).sum(axis=0), gram + exact_gram(rows)
        if n:
            values = [decimal.Decimal(int(v)) for v in [n, *sums, *gram[upper]]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["entry", "value"])

    parts = fit.mapInArrow(summed, "entry int, value decimal(38,0)")
    values = {r.entry: int(r.value) for r in parts.groupBy("entry").agg(F.sum("value").alias("value")).collect()}
    gram = np.zeros((d, d), object)
    for entry, (i, j) in enumerate(zip(*upper), d + 1):
        gram[i, j] = gram[j, i] = values[entry]
    return values[0], [values[1 + i] for i in range(d)], gram


def primes_below(limit: int, product: int) -> list[int]:
    """Primes from ``limit`` downwards whose product exceeds ``product``."""
    root = isqrt(limit) + 1
    sieve = np.ones(root + 1, bool)
    sieve[:2] = False
    for i in range(2, isqrt(root) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    small, out, n = np.flatnonzero(sieve), [], limit
    while not out or prod(out) <= product:
        n -= 1
        if (n % small[small < n]).all():
            out.append(n)
    return out


def characteristic_residues(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(t - matrix) modulo each prime (below 2**31), of t**0 first: Hessenberg form, then its recurrence."""
    d, q = len(matrix), len(primes)
    p = primes.astype(np.int64)
    h = np.stack([(matrix % int(x)).astype(np.int64) for x in p])
    at, each = p[:, None], np.arange(q)
    for k in range(d - 2):
        pivot = k + 1 + (h[:, k + 1 :, k] != 0).argmax(axis=1)
        rows = h[each, pivot]
        h[each, pivot], h[:, k + 1] = h[:, k + 1].copy(), rows
        columns = h[each, :, pivot]
        h[each, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), columns
        lead = h[:, k + 1, k]
        inverse = np.array([pow(int(v), -1, int(x)) if v else 0 for v, x in zip(lead, p)], np.int64)
        u = h[:, k + 2 :, k] * inverse[:, None] % at
        h[:, k + 2 :] = (h[:, k + 2 :] - u[:, :, None] * h[:, k + 1][:, None] % at[:, None]) % at[:, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None] % at[:, None]).sum(axis=2)) % at
    poly = np.zeros((d + 1, q, d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        new = (-h[:, k - 1, k - 1][:, None] * poly[k - 1]) % at
        new[:, 1:] += poly[k - 1][:, :-1]
        below = np.ones(q, np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            new -= (h[:, k - i - 1, k - 1] * below % p)[:, None] * poly[k - i - 1] % at
        poly[k] = new % at
    return poly[d]


def _characteristic(fit: DataFrame, scatter: np.ndarray) -> list[int]:
    """e_0 .. e_d, the elementary symmetric functions of the roots: none is negative, and Maclaurin's inequality bounds them."""
    spark, d = fit.sparkSession, len(scatter)
    trace = int(np.trace(scatter))
    primes = primes_below(1 << 31, max(comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = characteristic_residues(scatter, batch["prime"].to_numpy())[:, ::-1]
                yield pd.DataFrame({"k": np.tile(np.arange(d + 1), len(batch)), "prime": np.repeat(batch["prime"].to_numpy(), d + 1), "residue": found.ravel()})

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        modulus, total = prod(int(x) for x in rows["prime"]), 0
        for x, r in zip(rows["prime"].tolist(), rows["residue"].tolist()):
            rest = modulus // x
            total += r * rest * pow(rest, -1, x)
        sign = -1 if rows["k"].iloc[0] % 2 else 1
        return pd.DataFrame({"k": rows["k"].iloc[:1], "value": [str(sign * total % modulus)]})

    held = spark.createDataFrame([(x,) for x in primes], "prime long").repartition(max(1, len(primes) // 8))
    found = held.mapInPandas(residues, "k int, prime long, residue long").groupBy("k").applyInPandas(combine, "k int, value string")
    return [int(r.value) for r in sorted(found.collect())]


def _shifted(coefficients: list[int], a: int) -> list[int]:
    """Coefficients, of the highest power first, of the polynomial moved so that ``a`` becomes 0."""
    c = list(coefficients)
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += a * c[i - 1]
    return c


def roots_above(coefficients: list[int], a: int) -> int:
    """Roots beyond ``a``, with multiplicity: for a polynomial that has only real roots Descartes' count of signs is exact."""
    signs = [c > 0 for c in _shifted(coefficients, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolated_root(coefficients: list[int], k: int, top: int) -> tuple[int, int, int]:
    """The k-th largest root: (hi, first, last) with the root in (hi - 1, hi]; roots first..last, with multiplicity, lie there.

    Halved by counting until one root is left, and by the polynomial's sign from then on.
    """
    def value(x: int) -> int:
        total = 0
        for c in coefficients:
            total = total * x + c
        return total

    lo, hi, above_lo, above_hi = -1, top, len(coefficients) - 1, 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if above_lo - above_hi == 1:
            v = value(mid)
            if v == 0:
                return mid, above_lo, above_lo
            lo, hi = (mid, hi) if (v > 0) == (above_lo % 2 == 0) else (lo, mid)
            continue
        above = roots_above(coefficients, mid)
        if above >= k:
            lo, above_lo = mid, above
        else:
            hi, above_hi = mid, above
    return hi, above_hi + 1, above_lo


def null_vectors(matrix: np.ndarray, count: int) -> list[np.ndarray]:
    """``count`` orthogonal integer vectors that span the (nearly) null space of an integer matrix: elimination in fixed
    point once, then two rounds of inverse iteration on fixed start vectors. A pivot that vanishes counts as one unit."""
    d = len(matrix)
    u, steps = matrix.astype(object).copy(), []
    for k in range(d):
        best = k + int(np.argmax([abs(v) for v in u[k:, k]]))
        u[[k, best]] = u[[best, k]]
        if not u[k, k]:
            u[k, k] = 1
        m = (u[k + 1 :, k] << FRACTION) // u[k, k] if k + 1 < d else np.zeros(0, object)
        steps.append((best, m))
        if k + 1 < d:
            u[k + 1 :, k:] -= m[:, None] * u[k, k:][None] >> FRACTION

    def solved(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k, (best, m) in enumerate(steps):
            y[[k, best]] = y[[best, k]]
            if k + 1 < d:
                y[k + 1 :] -= m * y[k] >> FRACTION
        x = np.zeros(d, object)
        for k in reversed(range(d)):
            x[k] = (y[k] - (u[k, k + 1 :] * x[k + 1 :]).sum()) // u[k, k]
        return x

    def scaled(x: np.ndarray) -> np.ndarray:
        """The largest entry brought to ROOT_BITS + FRACTION bits."""
        bits = ROOT_BITS + FRACTION - max(int(abs(v)).bit_length() for v in x)
        return np.array([int(v) << bits if bits >= 0 else int(v) >> -bits for v in x], object)

    out: list[np.ndarray] = []
    for j in range(count):
        x = scaled(np.array([((i + 1) * 2654435761 + (j + 1) * 40503 * (i + 7) ** 2) % 1000003 - 500001 for i in range(d)], object))
        for _ in range(2):
            x = scaled(solved(x))
            for v in out:
                x = scaled(x * (v * v).sum() - v * (v * x).sum())
        out.append(x)
    return out


def principal_axes(fit: DataFrame, n: int, sums: list[int], gram: np.ndarray, most: int = COMPONENTS) -> list:
    """Components by falling eigenvalue of the covariance (divisor n), one row per component with a positive one, at most ``most``:
    ``component`` from 1, ``eigenvalue``, ``explained`` (its share of the trace) and ``axis``, a unit vector.
    """
    s = np.array(sums, object)
    scatter = n * gram - s[:, None] * s[None]
    trace = int(np.trace(scatter))
    if not trace:
        return []
    signed = [-e if k % 2 else e for k, e in enumerate(_characteristic(fit, scatter))]
    rank = roots_above(signed, 0)
    shift = max(0, ROOT_BITS - trace.bit_length())
    fine = [c << shift * k for k, c in enumerate(signed)]

    def component(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch["component"].tolist():
                root, first, last = isolated_root(fine, k, (trace << shift) + 1)
                shifted = np.array([[int(v) << shift for v in row] for row in scatter], object)
                shifted[np.diag_indices(len(shifted))] -= root
                axis = null_vectors(shifted, k - first + 1)[-1]
                axis = np.array([int(v) / (1 << ROOT_BITS + FRACTION) for v in axis])
                axis /= np.sqrt((axis**2).sum())
                axis *= np.sign(axis[np.abs(axis).argmax()])
                rows.append((k, root / (n * n << shift), root / (trace << shift), axis.tolist()))
            if rows:
                yield pd.DataFrame(rows, columns=["component", "eigenvalue", "explained", "axis"])

    wanted = fit.sparkSession.createDataFrame([(k,) for k in range(1, min(most, rank) + 1)], "component int")
    return sorted(wanted.repartition(min(most, rank), "component").mapInPandas(component, _AXIS).collect())


def _projector(n: int, sums: list[int], axes: list):
    """Function: whole-number rows to (exact n * row - sums, whitened values)."""
    s = np.array(sums, object)
    turn = np.array([r.axis for r in axes]).T / np.sqrt([r.eigenvalue for r in axes])

    def project(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small = (int(np.abs(rows).max(initial=0)) * n + max(abs(int(v)) for v in sums)) < 1 << 62
        centred = rows * n - s.astype(np.int64) if small else rows.astype(object) * n - s
        return centred, (centred / n).astype(float) @ turn

    return project


def _identity_error(fit: DataFrame, n: int, project, count: int) -> float:
    """Largest entry of the covariance of whitened ``fit``, less the identity; tasks hand on one sum per entry."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for batch in batches:
            if batch.num_rows:
                z = project(_matrix(batch.column(0)))[1]
                total += np.vstack([z.sum(axis=0), z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["entry", "value"])

    sums = fit.mapInArrow(summed, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((count + 1) * count)
    for r in sums:
        total[r.entry] = r.value
    total = total.reshape(count + 1, count) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(count)).max())


def whiten_players(players: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened attributes of players, one row per row of ``players`` and component.

    ``players``: ``player_id``, ``attributes`` (array of numbers). Entries are cut to whole numbers of 1 / STEPS. Mean and
    covariance (divisor n) are those of the n distinct vectors. Returns ``player_id``, ``component`` (from 1, by falling
    eigenvalue, at most ``most``), ``n``, ``deviation`` (sum over entries of (n * x - sum of x)**2, exact), ``whitened`` (the
    centred vector on the component, over the root of its eigenvalue), ``explained`` (share of the covariance's trace) and
    ``identity_error`` (one value: how far the covariance of whitened distinct vectors is from the identity, largest entry).

    Vectors that are NULL, or hold a NULL or an entry that is not finite, take no part; nor do vectors of another length than
    the most frequent one (the longer, if two are). Entries beyond FARTHEST / STEPS count as that. Components without
    variance are left out, so equal vectors, a single one or an empty table give no rows. Repeated rows and rows with a NULL
    player are returned like any other; equal vectors count once in the fit. Axes of equal eigenvalues are an arbitrary but
    fixed orthogonal choice. Further columns are not read. Two vectors are equal when all whole numbers are: a shuffle of
    distinct vectors, after each task has dropped its own repeats. The work beside that grows with the dimension alone.
    """
    spark = players.sparkSession
    rows = players.where(usable(F.col("attributes"))).select(F.col("player_id").cast("bigint"), whole(F.col("attributes")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], _RESULT)
    if sizes is None:
        return empty
    rows = rows.where(F.size("x") == sizes.d)
    fit = stored(rows.select("x").distinct())
    n, sums, gram = _moments(fit, sizes.d)
    axes = principal_axes(fit, n, sums, gram, most)
    if not axes:
        return empty
    project = _projector(n, sums, axes)
    error, count = _identity_error(fit, n, project, len(axes)), len(axes)
    explained = np.array([r.explained for r in axes])

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred, z = project(_matrix(batch.column(1)))
            if centred.dtype != object and (np.abs(centred).max().astype(float) ** 2) * sizes.d < 2.0**62:
                deviation = pa.array((centred**2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([decimal.Decimal(int(v)) for v in (centred.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
            each, m = np.repeat(np.arange(len(z)), count), z.size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))), pa.array(np.full(m, n)),
                    deviation.take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(m, error)),
                ],
                ["player_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(whitened, _RESULT)
