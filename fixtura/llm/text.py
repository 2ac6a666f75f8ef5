"""Array work on batches of texts: whole texts as code points, n-grams and words by position.

Texts are taken in pieces of about PIECE characters, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

PIECE = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: Sequence[str | None], size: int = PIECE) -> Iterator[list[str]]:
    """Consecutive runs of texts, cut once a run has ``size`` characters; None reads as empty."""
    run, length = [], 0
    for t in texts:
        run.append(t or "")
        length += len(run[-1])
        if length >= size:
            yield run
            run, length = [], 0
    if run:
        yield run


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts, and where each text starts (with the end as last entry)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _codes() -> np.ndarray:
    """A 64-bit code per code point."""
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


@cache
def _alphabetic() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


def letter_stream(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of each text; every run of other characters, and each end, is one space."""
    points, starts = code_points([f" {t.lower()} " for t in texts])
    points = np.where(_alphabetic()[points], points, np.uint32(32))
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    keep[starts[:-1]] = True
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return points[keep], ends[starts]


def ngram_hashes(points: np.ndarray, orders: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(order, hash of the n-gram at each position); the caller leaves out those that run past their text."""
    codes = _codes()[points]
    rolled, power = np.zeros(len(points), np.uint64), np.uint64(1)
    for n in range(1, max(orders) + 1):
        if n > len(points):
            return
        rolled = rolled[: len(points) - n + 1] + codes[n - 1 :] * power
        power = np.uint64(int(power) * int(_ODD) % 2**64)
        if n in orders:
            yield n, rolled


def owner(starts: np.ndarray) -> np.ndarray:
    """Index of the text that each position belongs to."""
    return np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))


def words(points: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text index of every word, in order. ``gap`` marks positions that belong to no word."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    first = np.zeros(len(points), bool)
    first[starts[:-1][starts[:-1] < len(points)]] = True
    inside = ~gap
    begins = inside.copy()
    begins[1:] &= gap[:-1] | first[1:]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    place = np.arange(len(points)) - np.repeat(np.r_[0, at], np.diff(np.r_[0, at, len(points)]))
    powers = np.cumprod(np.full(int(place[at[0]:].max()) + 1, _ODD, np.uint64), dtype=np.uint64)
    place[: at[0]] = 0
    value = _codes()[points] * powers[np.minimum(place, len(powers) - 1)]
    value[gap] = 0
    return mix64(np.add.reduceat(value, at)), np.searchsorted(starts, at, "right").astype(np.int32) - 1
