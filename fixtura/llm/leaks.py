"""Held-out text inside other pages: offset-adjusted postings of the rarest terms, then phrase and proximity matches.

Column functions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.llm.store import stored
from fixtura.runtime import sized_broadcast

WINDOW_WORDS = 10
# Proximity: words may stand up to SLOP positions from their places, and one word in MISSING_OF may be missing.
SLOP = 3
MISSING_OF = 5
# Marks, probes and hashes of texts are broadcast up to this many rows (at most about 60 bytes each).
PROBE_ROWS = 1_000_000
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = "".join(chr(i) for i in range(0x80) if not (0x30 <= i <= 0x39 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A))


def words(text: Column) -> Column:
    """Words in order: runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. NULL has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _GAPS, _CAPITALS.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _ident(text: Column) -> list[Column]:
    """128 bits that stand for a text: pages with the same text have the same matches."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")]


def held_out_windows(held_out: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """(distinct windows, names of each window).

    A window is ``size`` consecutive words; an item with fewer, but some, is one window; an item without words has none.
    Windows: ``wid``, ``run`` (its words), ``len``, and one place where it stands: ``iid`` (a distinct item) and ``at`` (word,
    from 0). Names: ``wid``, ``wiki_page``.
    """
    item = held_out.select("wiki_page", words(F.col("page_text")).alias("w")).where("size(w) > 0")
    texts = stored(item.select("w").distinct().select(F.monotonically_increasing_id().alias("iid"), "w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))
    cut = texts.select("iid", "w", F.explode(starts).alias("at")).select("iid", "at", F.slice("w", F.col("at") + 1, F.lit(size)).alias("run"))
    windows = stored(
        cut.groupBy("run").agg(F.min(F.struct("iid", "at")).alias("place"))
        .select(F.monotonically_increasing_id().alias("wid"), "run", F.size("run").alias("len"), "place.iid", "place.at")
    )
    names = item.join(texts, "w").select("iid", "wiki_page").join(cut, "iid").join(windows.select("wid", "run"), "run")
    return windows, stored(names.select("wid", "wiki_page").distinct())


def probes(pages: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """The ``count`` rarest terms of each window among those that ``pages`` hold, rank 1 the rarest: (wid, rank, len, iid, at,
    place, term) with the word ``place`` of the item where the term stands. Rarity is the number of occurrences in all pages."""
    terms = windows.select("wid", "len", "iid", "at", F.posexplode("run").alias("offset", "term"))
    vocabulary = sized_broadcast(stored(terms.select("term").distinct()))
    counts = pages.select(F.explode(words(F.col("page_text"))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("wid").orderBy("n", "term", "offset"))
    ranked = terms.join(stored(counts), "term").withColumn("rank", rank).where(F.col("rank") <= count)
    return ranked.select("wid", "rank", "len", "iid", "at", (F.col("at") + F.col("offset")).alias("place"), "term")


def postings(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Index of the probe terms: (row, t1, t2, iid, place, diagonal, lone). ``diagonal`` is the position in the text less ``place``,
    so all words of a copied stretch lie on one diagonal. ``row`` tells copies of a text apart, so none is a hot group.

    Windows that overlap share their probes, so a word of a text is posted once per item and place, not once per window.
    ``marks``: (term, iid, place, lone). The mark table joins by broadcast if it is small enough and by a shuffle otherwise.
    """
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), *_ident(F.col("page_text")), words(F.col("page_text")).alias("w"))
    w = numbered.select("row", "t1", "t2", F.posexplode("w").alias("pos", "term"))
    found = w.join(sized_broadcast(marks, PROBE_ROWS), "term")
    return found.select("row", "t1", "t2", "iid", "place", (F.col("pos") - F.col("place")).alias("diagonal"), "lone")


def _candidates(pages: DataFrame, windows: DataFrame, size: int, slop: int) -> DataFrame:
    """(wid, t1, t2, start): where a probe of a window stands at its place and another one of it within ``slop`` of its own.

    Two probes of an item within ``slop`` diagonals are looked for first; only postings that have such company are taken to
    the windows that use them, and asked again window by window. A window of one word needs no company.
    """
    probe = stored(probes(pages, windows, size // MISSING_OF + 2))
    marks = stored(probe.groupBy("term", "iid", "place").agg(F.max(F.col("len") == 1).alias("lone")))
    around = W.partitionBy("row", "iid").orderBy("diagonal").rangeBetween(-slop, slop)
    near = postings(pages, marks).withColumns({"low": F.min("place").over(around), "high": F.max("place").over(around)})
    near = near.where("low < high OR lone").select("t1", "t2", "iid", "place", "diagonal").distinct()
    starts = near.join(sized_broadcast(probe.drop("term"), PROBE_ROWS), ["iid", "place"]).select(
        "wid", "t1", "t2", "rank", "len", (F.col("diagonal") + F.col("at")).alias("start")
    )
    of_window = W.partitionBy("wid", "t1", "t2").orderBy("start").rangeBetween(-slop, slop)
    agreed = starts.withColumns({"low": F.min("rank").over(of_window), "high": F.max("rank").over(of_window)}).where("low < high OR len = 1")
    return stored(agreed.select("wid", "t1", "t2", "start").distinct())


def near_matches(pages: DataFrame, windows: DataFrame, size: int = WINDOW_WORDS, slop: int = SLOP) -> DataFrame:
    """(wid, t1, t2, start, len, kind): every occurrence of a window as a ``phrase``, and in ``proximity``: one of its probe
    terms stands at its place, and of all its words at most one in MISSING_OF does not stand within ``slop`` positions of its own.

    There are two probes more than words may be missing, so any such passage has two of them within ``slop``; those are
    looked for first, then all words are compared. Phrases do not depend on ``slop``. Of proximity matches of a window that
    begin within ``slop`` of one another the first is returned, and none beside a phrase. A match is cut at the edges of its
    text. NULL and empty texts match nothing; equal texts are one; either table may be empty; further columns are not read.
    """
    key = ["wid", "t1", "t2"]
    around = W.partitionBy(*key).orderBy("start").rangeBetween(-slop, slop)
    candidates = _candidates(pages, windows, size, slop)
    holding = sized_broadcast(candidates.select("t1", "t2").distinct(), PROBE_ROWS)
    # Texts without a candidate are left out before any text is moved; a candidate takes along the words around it.
    texts = pages.select(*_ident(F.col("page_text")), F.coalesce("page_text", F.lit("")).alias("text")).join(holding, ["t1", "t2"], "left_semi")
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text")).select("t1", "t2", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    base = F.greatest(F.lit(0), F.col("start") - slop)
    wanted = candidates.join(sized_broadcast(windows.select("wid", "run", "len")), "wid")
    at = texts.join(wanted, ["t1", "t2"]).select(
        *key, "start", "len", "n", "run", (F.col("start") - base).alias("shift"), F.slice("w", base + 1, F.col("len") + 2 * slop).alias("w")
    )

    def stands(word: Column, place: Column) -> Column:
        first = F.greatest(F.lit(0), F.col("shift") + place - slop)
        return F.array_contains(F.slice("w", first + 1, F.greatest(F.lit(0), F.col("shift") + place + slop + 1 - first)), word)

    missing = F.size(F.filter("run", lambda word, place: ~stands(word, place)))
    exact = (F.col("start") >= 0) & (F.slice("w", F.greatest(F.lit(0), F.col("shift")) + 1, F.col("len")) == F.col("run"))
    held = at.where(missing <= F.floor(F.col("len") / MISSING_OF)).select(*key, "start", "len", "n", exact.alias("exact"))
    before = F.lag("start").over(W.partitionBy(*key).orderBy("start"))
    firsts = held.withColumns({"beside": F.max("exact").over(around), "gap": F.col("start") - before})
    begin = F.greatest(F.lit(0), F.col("start"))
    return firsts.where(F.col("exact") | (~F.col("beside") & (F.coalesce("gap", F.lit(slop + 1)) > slop))).select(
        *key, begin.alias("start"), (F.least(F.col("n"), F.col("start") + F.col("len")) - begin).alias("len"),
        F.when(F.col("exact"), F.lit("phrase")).otherwise(F.lit("proximity")).alias("kind"),
    )


def find_matches(pages: DataFrame, held_out: DataFrame, size: int = WINDOW_WORDS, slop: int = SLOP) -> DataFrame:
    """All matches of held-out windows, one row per row of ``pages``, match and held-out name: ``tournament_id``,
    ``wiki_page``, ``kind`` (``phrase`` or ``proximity``), ``start`` (word, from 0) and ``len``. See ``near_matches``.

    Rows with a NULL key and repeated rows match like any other; a held-out row with a NULL name matches under that name. NULL
    and empty texts have no matches. Either table may be empty. Further columns are not read.
    """
    windows, items = held_out_windows(held_out, size)
    found = near_matches(pages, windows, size, slop).join(sized_broadcast(items), "wid")
    hits = stored(found.select("t1", "t2", "wiki_page", "kind", "start", "len").distinct())
    rows = pages.select("tournament_id", *_ident(F.col("page_text")))
    return rows.join(hits, ["t1", "t2"]).select("tournament_id", "wiki_page", "kind", "start", "len")


def hit_words(found: DataFrame) -> DataFrame:
    """(t1, t2, n_hit): words of a text that lie inside any match, each counted once."""
    spans = found.select("t1", "t2", "start", (F.col("start") + F.col("len")).alias("end")).groupBy("t1", "t2", "start").agg(F.max("end").alias("end"))
    before = W.partitionBy("t1", "t2").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    return fresh.groupBy("t1", "t2").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias("n_hit"))


def find_leaks(pages: DataFrame, held_out: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """What each page holds of the held-out pages.

    ``pages``: ``tournament_id``, ``page_text``. ``held_out``: ``wiki_page``, ``page_text``. Returns per row of ``pages``:
    ``tournament_id``, ``n_words``, ``n_hit`` (words inside any occurrence of a held-out window) and ``leaked``, the sorted
    ``wiki_page`` names (as text, each once) with an occurring window.

    NULL and empty texts have no words. Rows with a NULL key and repeated rows are returned like any other; a held-out row
    with a NULL name still hits but is named nowhere. Either table may be empty; further columns are not read. Nothing is
    grouped by page but its own matches, and identical texts share one set of them. Of the matches only
    the phrases count here; ``find_matches`` returns all.
    """
    windows, items = held_out_windows(held_out, size)
    found = stored(near_matches(pages, windows, size).where("kind = 'phrase'"))
    named = found.select("t1", "t2", "wid").distinct().join(sized_broadcast(items), "wid").groupBy("t1", "t2").agg(
        F.array_sort(F.collect_set(F.col("wiki_page").cast("string"))).alias("leaked")
    )
    # Stored, so that the rows of a text with many copies meet it in a join whose partitions can be split.
    hits = stored(hit_words(found).join(named, ["t1", "t2"], "left"))
    rows = pages.select("tournament_id", *_ident(F.col("page_text")), F.size(words(F.col("page_text"))).alias("n_words"))
    return rows.join(hits, ["t1", "t2"], "left").select(
        "tournament_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("leaked", F.array().cast("array<string>")).alias("leaked"),
    )


def without_leaks(pages: DataFrame, text: str, held_out: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Rows of ``pages``, all columns, whose ``text`` holds no held-out window: the phrases of ``near_matches``.

    Rows with a NULL or empty text stay, and repeated rows share their fate. Either table may be empty.
    """
    windows, _ = held_out_windows(held_out, size)
    read = pages.select(F.col(f"`{text}`").alias("page_text"))
    found = near_matches(read, windows, size, slop=0).where("kind = 'phrase'")
    hit = stored(found.select("t1", "t2").distinct())
    t1, t2 = _ident(F.col(f"p.`{text}`"))
    return pages.alias("p").join(sized_broadcast(hit, PROBE_ROWS).alias("h"), (t1 == F.col("h.t1")) & (t2 == F.col("h.t2")), "left_anti")
