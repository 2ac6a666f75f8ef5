"""Log-likelihood of pages under a recurrent language model that is trained on other pages.

Words are counted over all pages to learn from. The model reads word numbers: of a shortlist of frequent words, and of the
spelling of any other. It is trained in rounds; in each, every task goes on from the common parameters over its own pages and
the results are averaged in a tree. What a word outside the shortlist adds depends on its count alone: the counts of frequent
words are broadcast, those of all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log, log10
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm import recurrent as R
from fixtura.llm.store import stored, text_batches

# Size of the model's vocabulary: words with parameters of their own (the end of a text is one), and classes by spelling.
SHORTLIST = 2_048
SPELLINGS = 32
# Counts are broadcast for at most so many words of at most so many bytes; all others are joined.
COUNTED = 1 << 18
LONGEST = 64
ROUNDS = 4
# Tokens that texts are read in at once, tokens of a piece in training, and words counted before they are handed on.
GROUP = 1 << 20
PIECE = 1_024
# Lanes and tokens of a window when whole texts are scored: fewer lanes, so that the longest text ends with the others.
LANES = 128
WINDOW = 64
HELD = 500_000
FAN_IN = 5
_PAGE = "uid long, tournament_id long, learn boolean, n_tokens long, n_known long, base double, rest double"


def tokens(text: bytes) -> list[bytes]:
    """Words: runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def spelling(word: bytes) -> int:
    """Class of a word by its last two bytes."""
    return crc32(word[-2:]) % SPELLINGS


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, spelling, n) over the UTF-8 ``text`` of all rows; the NULL word stands for the ends of texts."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, held = 0, Counter()

        def rows() -> pa.RecordBatch:
            words = [None, *held]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([-1, *map(spelling, held)], pa.int32()), pa.array([ends, *held.values()], pa.int64())],
                ["word", "spelling", "n"],
            )

        for batch in batches:
            ends += batch.num_rows
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) > HELD:
                yield rows()
                ends, held = 0, Counter()
        if ends:
            yield rows()

    return pages.select("text").mapInArrow(counted, "word binary, spelling int, n long").groupBy("word", "spelling").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What tasks know of the counts: the most frequent words, and sums by spelling of words outside the shortlist."""

    def __init__(self, words: DataFrame):
        total = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
        self.total, self.distinct, ends = (int(v or 0) for v in total)
        bins = words.where(F.octet_length("word") <= LONGEST).groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"))
        self.least, room = 1 << 62, COUNTED
        for r in sorted(bins.collect(), reverse=True):
            room -= r.words
            if room < 0:
                break
            self.least = int(r.n)
        known = sorted(words.where(self._is_known()).collect(), key=lambda r: (-r.n, bytes(r.word)))
        self.words, self.counts = [bytes(r.word) for r in known], np.array([r.n for r in known], np.int64)
        of = np.array([r.spelling for r in known], np.int32)
        short = min(SHORTLIST - 1, len(known))
        self.numbers = np.r_[np.arange(1, short + 1, dtype=np.int32), SHORTLIST + of[short:]]
        seen = words.where(F.col("word").isNotNull()).groupBy("spelling").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        n, v = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
        for r in seen:
            n[r.spelling], v[r.spelling] = r.n, r.v
        n -= np.bincount(of[:short], self.counts[:short], SPELLINGS)
        v -= np.bincount(of[:short], minlength=SPELLINGS)
        self.spelled, self.ends = n + v + 1, ends
        self.shortlist = np.zeros(SHORTLIST)
        self.shortlist[: short + 1] = np.r_[max(1, ends), self.counts[:short]]
        self.classes = np.r_[self.shortlist.reshape(-1, R.CLASS_WORDS).sum(axis=1), n]

    def _is_known(self) -> Column:
        return (F.octet_length("word") <= LONGEST) & (F.col("n") >= self.least)

    def others(self, words: DataFrame) -> DataFrame:
        """Words whose counts are not broadcast."""
        return words.where(F.col("word").isNotNull() & ~self._is_known()).select("word", "n")


def _numbered(pages: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Pages as word numbers, with what counts alone say: ``base`` and ``rest`` (the part of words outside the shortlist) but for
    the words in ``outside``, which occur ``times`` times and whose counts are not known here."""
    held = pages.sparkSession.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        number = dict(zip(v.words, range(len(v.words))))
        numbers, counts, short = v.numbers, np.log10(v.counts + 1.0), min(SHORTLIST - 1, len(v.words))
        spelled, nothing = np.log10(v.spelled), log10(v.total + v.distinct + 1)
        end = log10(v.ends + 1) - nothing
        for batch in batches:
            uid, key, learn, texts = batch.columns
            ids, ends, sums, outside, times = [], [0], [], [], []
            for text in texts.to_pylist():
                words = tokens(text)
                at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                unknown = at < 0
                own = np.where(unknown, 0, numbers[at] if len(numbers) else 0).astype(np.int32)
                missing = [words[i] for i in np.flatnonzero(unknown).tolist()]
                own[unknown] = [SHORTLIST + spelling(w) for w in missing]
                base = counts[at[~unknown]].sum() - len(words) * nothing + end
                rest = counts[at[at >= short]].sum() - spelled[own[own >= SHORTLIST] - SHORTLIST].sum()
                sums.append((len(words) + 1, len(words) - len(missing) + (v.ends > 0), base, rest))
                ids += [own, np.array([R.END], np.int32)]
                ends.append(ends[-1] + len(words) + 1)
                tally = Counter(missing)
                outside.append(list(tally))
                times.append(list(tally.values()))
            if sums:
                n, known, base, rest = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        uid, key, learn, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rest, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))),
                        pa.array(outside, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())),
                    ],
                    ["uid", "tournament_id", "learn", "n_tokens", "n_known", "base", "rest", "ids", "outside", "times"],
                )

    return pages.mapInArrow(numbered, f"{_PAGE}, ids array<int>, outside array<binary>, times array<int>")


def _groups(batches: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches with at least ``size`` tokens together: (table, tokens of all texts, their sizes). ``ids`` is the last column."""
    held, count = [], 0

    def taken():
        lists = [b.columns[-1] for b in held]
        return (
            pa.Table.from_batches(held), np.concatenate([x.flatten().to_numpy() for x in lists]),
            np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64),
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += len(batch.columns[-1].flatten())
            if count >= size:
                yield taken()
                held, count = [], 0
    if held:
        yield taken()


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Average of parameters of one name, weighted by the tokens that they were trained on."""
    weight = rows["weight"].to_numpy(float)
    out = {"name": rows["name"].iloc[:1].tolist(), "part": rows["part"].iloc[:1].tolist(), "weight": [int(weight.sum())]}
    for c in ("moved", "steps"):
        total = sum(w * np.frombuffer(v, np.float32).astype(float) for w, v in zip(weight, rows[c]))
        out[c] = [(total / weight.sum()).astype(np.float32).tobytes()]
    return pd.DataFrame(out)


def train(numbered: DataFrame, p: R.Parameters) -> R.Parameters:
    """Parameters after ROUNDS rounds over ``uid``, ``ids``. Each page is read in one round, drawn by hash; a round's tasks start
    from the same parameters, and their results are averaged FAN_IN binary digits of tasks at a time."""
    spark, steps = numbered.sparkSession, R.fresh_steps(p)
    schema = "name string, part int, weight long, moved binary, steps binary"
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast((p, steps))

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved, own = ({k: v.copy() for k, v in x.items()} for x in start.value)
            weight = 0
            for _, tokens_, sizes in _groups(batches):
                R.read(moved, tokens_, sizes, own, PIECE)
                weight += len(tokens_)
            if weight:
                names, part = list(moved), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names), pa.array([part] * len(names), pa.int32()), pa.array([weight] * len(names), pa.int64()),
                        pa.array([moved[k].tobytes() for k in names], pa.binary()), pa.array([own[k].tobytes() for k in names], pa.binary()),
                    ],
                    ["name", "part", "weight", "moved", "steps"],
                )

        rows = stored(numbered.where(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == turn).select("ids").mapInArrow(trained, schema))
        parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            rows = rows.withColumn("part", F.shiftright("part", FAN_IN)).groupBy("name", "part").applyInPandas(_merged, schema)
            parts = -(-parts >> FAN_IN)
        done = rows.collect()
        start.unpersist()
        if done:
            p, steps = ({r.name: np.frombuffer(bytes(r[c]), np.float32).reshape(x[r.name].shape) for r in done} for c, x in (("moved", p), ("steps", steps)))
    return p


def page_fluency(pages: DataFrame, learn: Column) -> DataFrame:
    """How likely a language model finds each page, one row per row of ``pages``: ``tournament_id``, ``learn``, ``n_tokens``,
    ``n_known`` (tokens that occur in the pages learnt from), ``train_tokens`` (tokens learnt from), ``base_score`` (their log10
    probability by counts with one added, unknown tokens sharing one place) and ``score`` (by the model), both for the whole text.

    ``pages``: ``tournament_id``, ``page_text``. ``learn`` tells which rows the model may learn from; NULL is no. A text is its
    words, see ``tokens``, and one end. The model is a gated recurrent network whose state runs through the whole text. It
    predicts a class and, among classes of shortlisted words, a word; within a class by spelling a word has its share of the
    counts with one added, and words that were not seen share one place. So a text's probabilities are those of one distribution.

    NULL and empty texts are one end. Rows with a NULL key, repeated rows and very long texts are scored like any other. An empty
    table gives an empty result; without rows to learn from all classes are alike, and ``base_score`` is 0. Further columns are
    not read. Counts and training cover all rows to learn from, and memory follows GROUP or the longest text. A retried task
    repeats its result, as parts of a table are read in the same order.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"), F.col("tournament_id").cast("bigint").alias("tournament_id"),
        F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce("page_text", F.lit("")).cast("binary").alias("text"),
    )
    with text_batches(spark):
        words = stored(word_counts(rows.where("learn")))
        vocabulary = Vocabulary(words)
        numbered = stored(_numbered(rows, vocabulary))
        model = spark.sparkContext.broadcast(train(numbered.where("learn"), R.fresh(vocabulary.shortlist, vocabulary.classes)))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, tokens_, sizes in _groups(batches, 2 * GROUP):
                logp = R.read(model.value, tokens_, sizes, width=LANES, time=WINDOW) / log(10)
                yield from table.drop_columns("ids").append_column("logp", pa.array(logp)).combine_chunks().to_batches()

        scores = stored(numbered.select("uid", "tournament_id", "learn", "n_tokens", "n_known", "base", "rest", "ids").mapInArrow(scored, f"{_PAGE}, logp double"))
    outside = numbered.select("uid", F.explode(F.arrays_zip("outside", "times")).alias("o")).select("uid", F.col("o.outside").alias("word"), "o.times")
    rare = outside.join(vocabulary.others(words), "word").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare"), F.sum("times").alias("n_rare")
    )
    more = F.coalesce("rare", F.lit(0.0))
    return scores.join(rare, "uid", "left").select(
        "tournament_id", "learn", "n_tokens", (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("logp") + F.col("rest") + more).alias("score"),
    )
