"""Label of a name or text by cross-parsing: which label's training text covers it in the fewest phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.store import small_batches, stored
from fixtura.llm.text import letter_stream, pieces

# Training letters per label, and cells of all transition tables together (four bytes each, per Python worker).
LETTERS = 32_768
CELLS = 24_000_000
# Distinct texts per label that are brought in to choose from.
CANDIDATES = 400
# Symbols in a lane: parsing starts anew after so many, so one long text is many lanes.
LANE = 1_024
UNKNOWN = "und"
BREAK = np.int32(1 << 30)


@dataclass(frozen=True)
class Samples:
    """Training text per label, labels sorted, and the letters that occur in any of them (space first)."""

    labels: tuple[str, ...]
    texts: tuple[str, ...]
    alphabet: str


def suffix_automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the automaton of all substrings; state 0 is the start, -1 is none."""
    table = np.full((2 * len(symbols) + 2, width), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    rows: list[dict[int, int]] = [{}]
    for c in symbols.tolist():
        new = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if p != -1:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(rows)
                rows.append(dict(rows[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    for state, row in enumerate(rows):
        if row:
            table[state, list(row)] = list(row.values())
    return table[: len(rows)]


def parser(automaton: np.ndarray) -> np.ndarray:
    """One step of greedy parsing per (state, symbol): the longest match goes on, or a new phrase begins (BREAK is set).

    Row 0 is the beginning of a text. One more row stands for "after a symbol that occurs nowhere": such a symbol is a
    phrase by itself.
    """
    lost = len(automaton)
    begin = np.where(automaton[0] >= 0, automaton[0], lost).astype(np.int32)
    steps = np.where(automaton >= 0, automaton, begin | BREAK).astype(np.int32)
    steps[0] = begin
    return np.vstack([steps, begin | BREAK])


@cache
def _tables(samples: Samples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parsers in one flat array, where each begins, and bits per phrase of each label. Built once per worker."""
    width = len(samples.alphabet) + 1
    code = _codes(samples.alphabet)
    parsers = [parser(suffix_automaton(code[letter_stream([t])[0]], width)) for t in samples.texts]
    bases = np.cumsum([0] + [p.size for p in parsers[:-1]])
    return np.concatenate([p.ravel() for p in parsers]), bases, np.log2([max(2, len(t)) for t in samples.texts])


def _codes(alphabet: str) -> np.ndarray:
    """Code point -> symbol; letters outside the alphabet share the last one."""
    code = np.full(0x110000, len(alphabet), np.int32)
    code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return code


def phrase_counts(texts: list[str], samples: Samples) -> tuple[np.ndarray, np.ndarray]:
    """(label, text) -> phrases of the text parsed against the label's sample, and the symbols of each text."""
    table, bases, _ = _tables(samples)
    width = len(samples.alphabet) + 1
    points, starts = letter_stream(texts)
    symbols = _codes(samples.alphabet)[points].astype(np.int64)
    sizes = np.diff(starts)
    lanes = -(-sizes // LANE)
    text = np.repeat(np.arange(len(texts)), lanes)
    begin = starts[:-1][text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    length = np.minimum(LANE, starts[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    text, begin, length = text[order], begin[order], length[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), "right")
    state = np.zeros((len(bases), len(text)), np.int64)
    phrases = np.ones((len(bases), len(text)), np.int64)
    for step, n in enumerate(active.tolist()):
        move = table[state[:, :n] * width + (symbols[begin[:n] + step] + bases[:, None])]
        phrases[:, :n] += move >> 30
        state[:, :n] = move & (BREAK - 1)
    return np.stack([np.bincount(text, row, len(texts)) for row in phrases]), sizes


def _sampled(texts: list[str], room: int) -> str:
    """Whole texts, in the given order, while they fit into ``room``; the beginning of the first one if none fits."""
    own, left = [], room
    for t in texts:
        if len(t) <= left:
            own.append(t)
            left -= len(t)
    if not any(map(str.isalpha, "".join(own))):
        first = next((i for i, c in enumerate(texts[0]) if c.isalpha()), 0)
        own = [texts[0][first : first + room]]
    return " ".join(own)


def _alphabet(texts: list[str]) -> str:
    return " " + "".join(sorted(filter(str.isalpha, set("".join(texts).lower()))))


def training_samples(records: DataFrame, text: str, label: str, letters: int = LETTERS) -> Samples:
    """Bounded training text per label: whole texts in the order of their hash while they fit into ``letters``.

    Candidates are the CANDIDATES distinct texts of each label with the smallest hashes, copies counted once, so the bound
    holds for any size of ``records`` and any number of copies. Texts longer than a quarter of ``letters`` are passed over
    if the label has shorter ones; otherwise each candidate gives a piece of that length, from a place that its hash names.
    Rows with NULL text or label, or a text without letters, do not count. The tables of all labels share CELLS, so with
    many labels or letters each gets less text, down to the beginning of one text. Every label that counts is in the
    result; if there is no room for that, it is an error.
    """
    small_batches(records.sparkSession)
    piece = max(2, letters // 4)
    rows = records.select(F.col(text).alias("text"), F.col(label).alias("label")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).select("text", "label", F.xxhash64("text").alias("h"), (F.length("text") > letters // 4).alias("long"))
    names = stored(rows.select("label", "h", "long").distinct())
    counts: dict = {}
    for r in names.groupBy("label", "long").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["label"], {})[r["long"]] = r["n"]
    if not counts:
        return Samples((), (), " ")
    only_long = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(False not in n))])

    def up_to(limits: dict) -> Column:
        """Rows of the sizes that the label learns from, with a hash up to its limit."""
        limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
        return (F.col("long") == only_long[F.col("label")]) & (F.col("h") <= limit[F.col("label")])

    # Twice as many as needed are expected below the limit; the ranks among them are exact.
    distinct = {k: n.get(False, n.get(True)) for k, n in counts.items()}
    drawn: dict = {}
    for r in names.where(up_to({k: min((1 << 63) - 1, (2 * CANDIDATES << 64) // n - (1 << 63)) for k, n in distinct.items()})).select("label", "h").collect():
        drawn.setdefault(r["label"], []).append(r["h"])
    chosen = rows.where(up_to({k: sorted(v)[:CANDIDATES][-1] for k, v in drawn.items()}))
    plain = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("plain") - piece + 1)).cast("int") + 1
    part = F.when(F.col("long"), F.substring("plain", start, F.lit(piece))).otherwise(F.col("text"))
    found = chosen.withColumn("plain", F.when(F.col("long"), plain)).select("label", "h", part.alias("text"))
    texts: dict = {}
    for r in found.dropDuplicates(["label", "h"]).orderBy("label", "h").collect():
        texts.setdefault(r["label"], []).append(r["text"])
    labels = sorted(texts)
    samples = [_sampled(texts[k], letters) for k in labels]
    room = min(letters, CELLS // (2 * len(_alphabet(samples)) + 2) // len(labels))
    if room < letters:
        samples = [_sampled(texts[k], room) for k in labels]
    if set(labels) != set(counts) or not all(any(map(str.isalpha, t)) for t in samples):
        raise ValueError(f"no room to learn {len(counts)} labels: {room} letters for each")
    return Samples(tuple(labels), tuple(samples), _alphabet(samples))


def predicted_label(text: Column, samples: Samples, spark) -> Column:
    """Struct (label, score) of a text; see ``predict_nationality``."""
    bc = spark.sparkContext.broadcast(samples)

    @F.pandas_udf("label string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = bc.value
        for series in batches:
            labels, scores = [], []
            for run in pieces(list(series)):
                if known.labels:
                    phrases, sizes = phrase_counts(run, known)
                    bits = phrases * _tables(known)[2][:, None] / sizes
                    best = bits.argmin(axis=0)
                    least = np.sort(bits, axis=0)
                    sure = 1 - least[0] / least[1] if len(least) > 1 else np.ones(len(run))
                for i, t in enumerate(run):
                    able = bool(known.labels) and any(map(str.isalpha, t))
                    labels.append(known.labels[best[i]] if able else UNKNOWN)
                    scores.append(float(sure[i]) if able else 0.0)
            yield pd.DataFrame({"label": labels, "score": scores})

    return predict(text)


def predict_nationality(ratings: DataFrame, known: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``player_id``, ``nationality_pred`` and ``score`` for every rating record, from its ``long_name`` alone.

    ``known``: ``long_name`` and ``nationality_name``, the records to learn from. A name is lower-cased, everything but
    letters becomes one space, and it is cut greedily into the longest phrases that occur in a label's training text
    (a letter that occurs nowhere is a phrase; parsing starts anew every LANE symbols). Phrases times log2 of the
    training length, per symbol, estimate the cross entropy; the smallest wins, ties go to the label that sorts first.
    ``score`` is the margin, 1 - smallest / second smallest (1 if only one label is known). A name that is NULL or has no
    letter, or anything when nothing can be learnt, is ``und`` with score 0. One row per row; NULL keys and repeats stay.
    """
    samples = training_samples(known, "long_name", "nationality_name", letters)
    guess = predicted_label(F.col("long_name"), samples, ratings.sparkSession)
    return ratings.select("player_id", guess.alias("guess")).select(
        "player_id", F.col("guess.label").alias("nationality_pred"), F.col("guess.score").alias("score")
    )
