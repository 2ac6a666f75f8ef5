"""Near-copies among pages: an exact Jaccard join of word n-gram sets as a blocked sparse product.

Work follows distinct sets, not pages. Sets that no other set can reach are sorted out first, by counting grams that
nothing else has; what is left is cut into small families, and each family is multiplied block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.components import components
from fixtura.llm.store import discard, let_go, small_batches, stored
from fixtura.llm.text import code_points, mix64, pieces, words
from fixtura.runtime import sized_broadcast

WORDS = 4
PERCENT = 85
# Grams that two pages of a family must share among their leading grams, and the most pages that a gram may lie in to
# propose pairs one by one. Neither changes which links are found.
SHARED = 3
COMMON = 32
BLOCK = 512
COLUMNS = 4_096
# Keys of the pages that are read again and common grams are broadcast up to this many (8 bytes each), family rows up to IN_FAMILY.
READ_AGAIN = 1_000_000
IN_FAMILY = 250_000
_FULL = 2.0**64


def gram_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a shorter text has one gram of all its words.

    Words are runs of anything but ASCII white space; A-Z are lower-cased.
    """
    points, starts = code_points(texts)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    h, own = words(points, starts, (points == 32) | ((points >= 9) & (points <= 13)))
    bounds = np.searchsorted(own, np.arange(len(texts) + 1))
    weights = mix64(np.arange(11, 11 + size, dtype=np.uint64))
    grams = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        grams += h[i : i + len(grams)] * weights[i]
    grams = mix64(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int(x.sum().astype(np.int64)) for x in (mix64(grams), mix64(grams ^ np.uint64(0x5555555555555555))))


def _part(n: float, percent: int) -> float:
    """Share of the hash range that stands for a set of ``n`` grams when lone grams are counted; never grows with n.

    It holds a third more grams than a partner may lack, or no long set could be seen to have too many lone ones."""
    return min(1.0, max((100 - percent) / 75, 64.0 / max(n, 1.0)))


def _head(grams: np.ndarray, share: float) -> int:
    """How many leading grams lie in the first ``share`` of the hash range."""
    return len(grams) if share >= 1 else int(np.searchsorted(grams, np.uint64(share * _FULL)))


def _described(size: int, percent: int, whole: bool):
    """Column function: size and signature of a text's set with the whole set, or with its head for the lone-gram count."""

    @F.pandas_udf("n long, s1 long, s2 long, tested int, grams array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            # One small frame per run of texts: sets of a whole batch are never held together.
            for run in pieces(list(series)):
                rows = []
                for g in gram_sets(run, size):
                    n = len(g)
                    head = g if whole else g[: _head(g, _part(n, percent))]
                    # A partner has at most n * 100 / percent grams; its head reaches at least this far.
                    rows.append((n, *_signature(g), _head(g, _part(n * 100 / percent, percent)), head.view(np.int64)))
                yield pd.DataFrame(rows, columns=["n", "s1", "s2", "tested", "grams"])

    return describe


def _may_miss(n: Column, percent: int) -> Column:
    """Grams of a set of ``n`` that a partner may lack."""
    return n - F.ceil(n * percent / 100)


def _reachable(classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Classes but those with more lone grams than a partner may lack. Grams are taken from the row that a class is named after."""
    heads = rows.select(F.col("uid").alias("cid"), "tested", "grams").join(sized_broadcast(classes.select("cid"), READ_AGAIN), "cid")
    grams = heads.select((F.col("cid") * 2).alias("code"), "tested", F.posexplode("grams").alias("pos", "gram")).select(
        "gram", (F.col("code") + (F.col("pos") < F.col("tested")).cast("long")).alias("code")
    )
    once = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("code").alias("code")).where("c = 1 AND code % 2 = 1")
    lone = once.groupBy(F.shiftright("code", 1).alias("cid")).agg(F.count(F.lit(1)).alias("lone"))
    light = classes.select("cid", "key", "n", "s1", "s2", "copies")
    return light.join(lone, "cid", "left").where(F.coalesce("lone", F.lit(0)) <= _may_miss(F.col("n"), percent)).drop("lone")


def _families(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, family): every linked pair lies within one family.

    Of sets in one global order of grams, two that share enough must share SHARED of their leading n - ceil(percent * n) +
    SHARED grams (or all they must share, if fewer). Grams in more than COMMON sets stand last in that order, so they lead
    only sets made of such grams. Pairs meet on rarer grams; a common leading gram ties its sets together as a star.
    """
    grams = sets.select("cid", F.explode("grams").alias("gram"))
    # Stored and counted before the join, so that not all grams are moved a second time to meet the few common ones.
    common = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON).select("gram"))
    let_go(sets.sparkSession)
    held = grams.join(sized_broadcast(common, READ_AGAIN), "gram").groupBy("cid").agg(F.array_sort(F.collect_list("gram")).alias("common"))
    size = F.least(F.col("n"), _may_miss(F.col("n"), percent) + SHARED).cast("int")
    none = F.array().cast("array<bigint>")
    lead = sets.join(held, "cid", "left").withColumn("common", F.coalesce("common", none)).withColumn(
        "rare", F.slice(F.array_except("grams", "common"), 1, size)
    )
    lead = stored(lead.select("cid", "n", "rare", F.slice("common", 1, F.greatest(F.lit(0), size - F.size("rare"))).alias("common")))
    let_go(sets.sparkSession)
    post = lead.select("cid", "n", F.explode("rare").alias("gram"))
    a, b = post.alias("a"), post.alias("b")
    close = (F.col("a.cid") < F.col("b.cid")) & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & close).groupBy(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).agg(
        F.count(F.lit(1)).alias("c"), F.max(F.greatest("a.n", "b.n")).alias("n")
    )
    pairs = met.where(F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))).select("u", "v")
    stars = lead.select("cid", F.explode("common").alias("gram"))
    hubs = stars.groupBy("gram").agg(F.min("cid").alias("v"))
    return components(pairs.union(stars.join(hubs, "gram").select(F.col("cid").alias("u"), "v"))).select(
        F.col("node").alias("cid"), F.col("component").alias("family")
    )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common grams of every two sets: the incidence matrix times its transpose, COLUMNS grams at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times >= 2
    place = np.cumsum(twice) - 1
    keep = twice[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(twice.sum()), COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        total += block @ block.T
    return total


def _linked(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one family, or between two of its blocks: per page its links, weighted by copies, and one page it reaches."""
    sets = [np.asarray(g, np.int64) for g in rows["grams"]]
    n, copies, block = rows["n"].to_numpy(float), rows["copies"].to_numpy(float), rows["block"].to_numpy()
    common = overlaps(sets).astype(float)
    link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(link, False)
    if block.min() != block.max():
        link &= block[:, None] != block[None, :]
    reach = np.full(len(rows), -1)
    for i in np.flatnonzero(link.any(axis=1)):
        if reach[i] < 0:
            front = np.zeros(len(rows), bool)
            front[i] = True
            while front.any():
                reach[front] = i
                front = link[front].any(axis=0) & (reach < 0)
    at = np.flatnonzero(reach >= 0)
    cid = rows["cid"].to_numpy()
    return pd.DataFrame({"u": cid[at], "v": cid[reach[at]], "links": (link[at] @ copies).astype(np.int64)})


def _product(sets: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(u, v, links) over all families. A family of more than BLOCK sets is dealt into blocks, and every two of them meet
    in a task of their own; small families share tasks. A task holds about two blocks, whatever the family."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    part = stored(families.join(sizes, "family").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    ))
    let_go(sets.sparkSession)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    dealt = sets.join(sized_broadcast(part, IN_FAMILY), "cid").withColumn("pair", F.explode(pairs)).select("cid", "n", "copies", "grams", "family", "block", "pair.*", "blocks")
    # Small families hash into as many groups as leave about BLOCK sets in each.
    groups = max(1, part.where("blocks = 1").count() // BLOCK)
    where = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.col("family"))

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_linked(own, percent) for _, own in rows.groupby("family")], ignore_index=True)

    return dealt.withColumns({"where": where, "large": F.col("blocks") > 1}).groupBy("where", "large", "i", "j").applyInPandas(
        multiply, "u long, v long, links long"
    )


def _ident(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")]


def keep_one_of_copies(records: DataFrame, key: str, text: str, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``records``, all columns, without those whose page belongs to a group of copies that a smaller key leads.

    Groups are those of ``page_copies``. Of rows that agree in key and text one stays; rows that repeat a key with another
    text are judged by their own text. Rows with a NULL key stay. Only keys and hashes of rows that go are joined.
    """
    read = records.select(F.col(f"`{key}`").alias("tournament_id"), F.col(f"`{text}`").alias("page_text"))
    marked = stored(_copies(read, size, percent))
    gone = marked.where("tournament_id > component").select("tournament_id", "t1", "t2").distinct()
    twice = marked.where("tournament_id = component").groupBy("tournament_id", "t1", "t2").count().where("count > 1").drop("count")
    gone, twice = stored(gone.union(twice)), stored(twice)
    t1, t2 = _ident(F.col(f"r.`{text}`"))
    on = (F.col(f"r.`{key}`") == F.col("g.tournament_id")) & (t1 == F.col("g.t1")) & (t2 == F.col("g.t2"))
    rows = records.alias("r")
    single = rows.join(sized_broadcast(gone, READ_AGAIN).alias("g"), on, "left_anti")
    return single.unionByName(rows.join(sized_broadcast(twice, READ_AGAIN).alias("g"), on, "left_semi").dropDuplicates([key, text]))


def page_copies(pages: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Near-copies of every page: ``tournament_id``, ``n_shingles``, ``component`` and ``n_links``.

    Two pages link when their sets of word ``size``-grams have 100 * common >= ``percent`` * all. ``component`` is the
    smallest ``tournament_id`` that links lead to, its own included; ``n_links`` counts linked pages, equal ones too.

    A page without words (or with NULL text) has no grams and no links and is its own component. A row with a NULL key
    links with nothing and has a NULL component. Rows that repeat a key are pages of their own with the same name. Two
    short pages link only if all their words agree. Further columns are not read; an empty table gives an empty result.
    The links are exact for 64-bit hashes of the grams.
    """
    return _copies(pages, size, percent).drop("t1", "t2")


def _copies(pages: DataFrame, size: int, percent: int) -> DataFrame:
    """``page_copies`` with the hash of each row's text, ``t1`` and ``t2``."""
    small_batches(pages.sparkSession)
    describe = _described(size, percent, whole=False)
    text = F.col("page_text")
    described = pages.select(
        F.monotonically_increasing_id().alias("uid"), F.col("tournament_id").alias("key"), *_ident(text), describe(F.coalesce(text, F.lit(""))).alias("d")
    )
    whole = stored(described.select("uid", "key", "t1", "t2", "d.*"))
    sig = ["n", "s1", "s2"]
    rows = stored(whole.select("uid", "key", "t1", "t2", *sig))
    # A class is named after one of its rows, so grams are written once and moved only gram by gram.
    classes = stored(
        rows.where("n > 0 AND key IS NOT NULL").groupBy(*sig).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.min("uid").alias("cid"))
    )
    close = stored(_reachable(classes, whole, percent))
    discard(whole)
    let_go(pages.sparkSession)
    again = pages.select(F.col("tournament_id").alias("key"), "page_text").join(sized_broadcast(close.select("key").distinct(), READ_AGAIN), "key")
    full = again.select(_described(size, percent, whole=True)(F.coalesce("page_text", F.lit(""))).alias("d")).select("d.*")
    # Whole sets are written where they are made; only where a key repeats with an equal text are there rows to drop.
    sets = stored(full.drop("tested").join(sized_broadcast(close.drop("key"), IN_FAMILY), sig).select(
        "cid", "n", "copies", "grams", F.monotonically_increasing_id().alias("at")
    ))
    let_go(pages.sparkSession)
    twice = stored(sets.groupBy("cid").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("least")).where("rows > 1").drop("rows"))
    if not twice.isEmpty():
        every = sets
        sets = stored(every.join(sized_broadcast(twice, IN_FAMILY), "cid", "left").where("least IS NULL OR at = least").drop("least"))
        discard(every)
    found = stored(_product(sets, _families(sets, percent), percent))
    discard(sets)
    degree = found.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    keys = classes.select("cid", *sig, "key", "copies")
    tied = components(found.select("u", "v")).select(F.col("node").alias("cid"), F.col("component").alias("root")).join(keys.select("cid", "key"), "cid")
    least = tied.groupBy("root").agg(F.min("key").alias("least"))
    named = tied.select("cid", "root").join(least, "root").join(degree, "cid").select("cid", "least", "links")
    of_class = keys.join(named, "cid", "left").select(
        *sig, F.coalesce("least", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    own = F.col("key").isNotNull() & (F.col("n") > 0)
    return rows.select("key", "t1", "t2", *sig).join(stored(of_class), sig, "left").select(
        F.col("key").alias("tournament_id"), "t1", "t2", F.col("n").alias("n_shingles"),
        F.when(own, F.col("component")).otherwise(F.col("key")).alias("component"), F.when(own, F.col("n_links")).otherwise(0).alias("n_links"),
    )
