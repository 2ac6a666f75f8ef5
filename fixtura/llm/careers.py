"""Careers that begin alike: the prefix trie of players' appearances, from sorted careers and range minima over their LCPs.

Distinct careers are sorted over all tasks. Each task cuts its stretch of the order into runs of bounded size. Inside a run
the members of every beginning are found by binary searches over a sparse table of minima, to the left and to the right
independently. Only beginnings of a run's first or last career can go on in other runs; those few are put together by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.llm.store import stored
from fixtura.llm.text import mix64
from fixtura.runtime import sized_broadcast

# Appearances that are held in memory at once.
RUN = 1 << 18
_NONE = hashlib.sha256(b"").hexdigest()
_ENDS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("least", pa.int64()), ("copies", pa.int64()), ("ends", pa.string())])
_NODE = (
    "open boolean, run long, side int, depth long, k1 long, k2 long, p1 long, p2 long, sofifa_player_id long, parent_player_id long, "
    "n_players long, n_children long, n_leaves long, saved_points long, points long, ends_sha256 string"
)
_RESULT = ["sofifa_player_id", "depth", "parent_player_id", "n_players", "n_children", "n_leaves", "saved_points", "ends_sha256"]


def careers(appearances: DataFrame) -> DataFrame:
    """(sofifa_player_id, steps): every player's appearances in order of ``year``, NULL first.

    A step stands for (position, club), NULL read as empty: 128 bits of hash and the code points of ``club``. Appearances of one
    year are ordered by position and then by hash; repeated rows are steps of their own. Rows without a player are left out.
    """
    position, club = F.coalesce(F.col("position").cast("string"), F.lit("")), F.coalesce(F.col("club").cast("string"), F.lit(""))
    step = F.struct(
        F.col("year"), position.alias("position"), F.xxhash64(position, club).alias("a"),
        F.xxhash64(F.lit(1), position, club).alias("b"), F.char_length(club).alias("points"),
    )
    rows = appearances.select(F.col("sofifa_player_id").cast("bigint"), step.alias("step")).where("sofifa_player_id IS NOT NULL")
    held = rows.groupBy("sofifa_player_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    # The order of NULL fields inside an array's structs is not relied on.
    undated, dated = F.filter("steps", lambda s: s.year.isNull()), F.filter("steps", lambda s: s.year.isNotNull())
    return held.select(
        "sofifa_player_id", F.transform(F.concat(undated, dated), lambda s: F.struct(s.a.alias("a"), s.b.alias("b"), s.points.alias("points"))).alias("steps")
    )


def with_borrowed_starts(own: DataFrame, donor: Column, lead: Column, most: int) -> DataFrame:
    """``careers`` rows in which the first ``lead`` steps are those of the career ``donor`` (all it has, if fewer; none if it is absent).

    ``lead`` is at most ``most``; only that many steps of a donor travel.
    """
    own = stored(own)
    wanted = own.select("sofifa_player_id", "steps", donor.cast("bigint").alias("donor"), lead.cast("int").alias("lead"))
    lent = own.select(F.col("sofifa_player_id").alias("donor"), F.slice("steps", 1, most).alias("lent"))
    lent = lent.join(wanted.select("donor").distinct(), "donor", "left_semi")
    none = F.filter("steps", lambda _: F.lit(False))
    start = F.slice(F.coalesce("lent", none), F.lit(1), F.col("lead"))
    rest = F.slice("steps", F.col("lead") + 1, F.greatest(F.lit(0), F.size("steps") - F.col("lead")))
    return wanted.join(lent, "donor", "left").select("sofifa_player_id", F.concat(start, rest).alias("steps"))


def _joined_players(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (s1, s2, player): per career and batch its least player, how many there are and their text."""
    for batch in batches:
        s1, s2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if len(s1):
            cuts = np.flatnonzero(np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
            text = [",".join(map(str, own.tolist())) for own in np.split(ids, cuts[1:])]
            columns = [s1[cuts], s2[cuts], ids[cuts], np.diff(np.r_[cuts, len(s1)]), text]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s1", "s2", "least", "copies", "text"])


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (s1, s2, least): per career the hash of all its players, fed to the hash as they come."""
    now, state, least, copies = None, None, 0, 0

    def closed(rows):
        return pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, r)) for r in rows], _ENDS)

    for batch in batches:
        done = []
        for s1, s2, first, count, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now == (s1, s2):
                state.update(f",{text}".encode())
                copies += count
                continue
            if now is not None:
                done.append((*now, least, copies, state.hexdigest()))
            now, state, least, copies = (s1, s2), hashlib.sha256(text.encode()), first, count
        if done:
            yield closed(done)
    if now is not None:
        yield closed([(*now, least, copies, state.hexdigest())])


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry i of level j is the least of the 2**j values from i on."""
    levels = [values]
    while 2 * (1 << len(levels) - 1) <= len(values):
        half = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def right_extent(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last position that shares its first ``depth`` steps with position ``at``: the LCPs in between reach ``depth``."""
    r, m = at.copy(), len(levels[0])
    for j in reversed(range(len(levels))):
        fits = r + (1 << j) < m
        r += np.where(fits & (levels[j][np.minimum(r + 1, len(levels[j]) - 1)] >= depth), 1 << j, 0)
    return r


def left_extent(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first position that shares its first ``depth`` steps with position ``at``."""
    left = at.copy()
    for j in reversed(range(len(levels))):
        start = left - (1 << j) + 1
        left -= np.where((start >= 1) & (levels[j][np.maximum(start, 0)] >= depth), 1 << j, 0)
    return left


def _common(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of every career with the one before it; -1 for the first."""
    size = np.diff(offsets)
    shared = np.minimum(size[:-1], size[1:])
    pair = np.repeat(np.arange(len(shared)), shared)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(shared) - shared, shared)
    same = (tokens[offsets[pair] + place] == tokens[offsets[pair + 1] + place]).all(axis=1)
    out = shared.copy()
    wrong = np.flatnonzero(~same)
    np.minimum.at(out, pair[wrong], place[wrong])
    return np.r_[-1, out]


def _run_nodes(number: int, tokens: np.ndarray, points: np.ndarray, offsets: np.ndarray, least: np.ndarray, copies: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """All beginnings of a run of sorted distinct careers. Beginnings of its first or last career are open: their sums are
    this run's share, without open ones below them. ``side``: 0 beginnings of both, 1 of the first only, 2 of the last only.
    """
    m, size = len(least), np.diff(offsets)
    lcp = _common(tokens, offsets)
    table = _minima(lcp)
    made = size - lcp
    first = np.r_[0, np.cumsum(made)]
    own = np.repeat(np.arange(m), made)
    depth = np.arange(first[-1]) - first[own] + lcp[own] + 1
    right = right_extent(table, own, depth)
    above = np.maximum(depth - 1, 0)
    left = left_extent(table, own, above)
    parent = first[left] + above - lcp[left] - 1

    side = np.full(len(own), -1)
    side[own == 0] = 1
    steps = np.arange(size[-1] + 1)
    at = left_extent(table, np.full(len(steps), m - 1), steps)
    last = first[at] + steps - lcp[at] - 1
    side[last] = np.where(side[last] == 1, 0, 2)
    is_open = side >= 0

    n = np.r_[0, np.cumsum(copies)]
    n = n[right + 1] - n[own]
    minima = _minima(least)
    level = np.frexp((right - own + 1).astype(float))[1] - 1
    player = np.empty(len(own), np.int64)
    for j in np.unique(level):
        x = level == j
        player[x] = np.minimum(minima[j][own[x]], minima[j][right[x] - (1 << int(j)) + 1])
    text = np.where(depth > 0, points[np.minimum(offsets[own] + above, max(0, len(points) - 1))], 0) if len(points) else np.zeros(len(own), np.int64)
    saved = np.r_[0, np.cumsum(np.where(is_open, 0, (n - 1) * text))]
    saved = saved[first[right + 1]] - saved[np.arange(len(own))]
    end = first[1:] - 1
    leaf = np.r_[lcp[1:] < size[:-1], True] & ~is_open[end]
    leaves = np.r_[0, np.cumsum(leaf)]
    leaves = leaves[right + 1] - leaves[own]
    below = np.bincount(parent[~is_open & (depth > 0)], minlength=len(own))

    weights = mix64(np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64)) | np.uint64(1)
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], size)
    keys = []
    for lane in range(2):
        total = np.r_[np.uint64(0), np.cumsum(mix64(tokens[:, lane].view(np.uint64)) * weights[place], dtype=np.uint64)]
        keys += [(total[offsets[own] + d] - total[offsets[own]]).view(np.int64) for d in (depth, above)]
    at_end = np.full(len(own), None, object)
    at_end[end] = ends
    closed_parent = (depth > 0) & ~is_open[parent]
    columns = {
        "open": is_open, "run": np.full(len(own), number), "side": side.astype(np.int32), "depth": depth, "k1": keys[0], "k2": keys[2],
        "p1": keys[1], "p2": keys[3], "sofifa_player_id": player, "parent_player_id": pa.array(player[parent], pa.int64(), mask=~closed_parent),
        "n_players": n, "n_children": below, "n_leaves": leaves, "saved_points": saved, "points": text.astype(np.int64),
        "ends_sha256": pa.array(np.where(is_open | (at_end != None), at_end, _NONE), pa.string()),  # noqa: E711
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _sorted_runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    number, held, turns = TaskContext.get().partitionId() << 32, [], 0

    def closed():
        lists = [[b.column(i) for b in held] for i in range(3)]
        a, b, points = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in own]) for own in lists)
        size = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists[0]]).astype(np.int64)
        least, copies, ends = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3, 6))
        tokens = np.stack([a, b], axis=1).astype(np.int64)
        return _run_nodes(number, tokens, points.astype(np.int64), np.r_[0, np.cumsum(size)], least, copies, ends)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        turns += len(batch.column(0).flatten()) + batch.num_rows
        if turns >= run:
            yield closed()
            number, held, turns = number + 1, [], 0
    if held:
        yield closed()


def _joined_open(nodes: DataFrame) -> DataFrame:
    """Open beginnings put together: one row per key, with the shares of all runs and of the open beginnings below."""
    key = ["k1", "k2", "depth"]
    parts = nodes.where("open")
    total = stored(
        parts.groupBy(*key).agg(
            F.min("run").alias("owner"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("points").alias("points"),
            F.min("sofifa_player_id").alias("sofifa_player_id"), F.max("ends_sha256").alias("ends_sha256"),
            *[F.sum(c).alias(c) for c in ("n_players", "n_children", "n_leaves", "saved_points")],
        )
    )
    lower = total.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("open_children")
    )
    total = total.join(lower, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    mine = F.col("run") == F.col("owner")
    own = parts.select("run", "side", *key).join(total.select(*key, "owner", "n_players", "n_children", "points"), key).select(
        "run", "side", *key, F.when(mine, (F.col("n_players") - 1) * F.col("points")).otherwise(0).alias("saved"),
        F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).alias("leaf"),
    )
    # A run's open beginnings are two paths with a common start.
    downward = W.partitionBy("run", "side").orderBy(F.desc("depth"))
    whole = W.partitionBy("run")
    shares = own.select(*key, *[
        (F.sum(c).over(downward) + F.when(F.col("side") == 0, F.sum(F.when(F.col("side") > 0, F.col(c)).otherwise(0)).over(whole)).otherwise(0)).alias(c)
        for c in ("saved", "leaf")
    ]).groupBy(*key).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    return stored(
        total.join(shares, key).select(
            *key, "p1", "p2", "sofifa_player_id", "n_players", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
            (F.col("saved_points") + F.col("saved")).alias("saved_points"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
        )
    )


def career_trie(own: DataFrame, run: int = RUN) -> DataFrame:
    """Every way in which careers begin, one row per distinct sequence of first steps, the empty one included.

    ``own``: rows of ``careers``, one per player. Returns ``sofifa_player_id`` (the smallest player whose career begins so),
    ``depth`` (steps), ``parent_player_id`` (that of the sequence without its last step; NULL for the empty one), ``n_players``,
    ``n_children`` (sequences of one step more), ``n_leaves`` (sequences below, itself included, that nothing continues),
    ``saved_points`` (over all sequences below, itself included: the players but one, times the code points of the last club)
    and ``ends_sha256`` (SHA-256 of the players whose career is just this, ascending, joined by commas).

    Careers without steps belong to the empty sequence alone. No careers give no rows. Players that repeat count each time.
    Further columns are not read. Equal careers are put together first, so a beginning shared by a third of all players is one
    entry per different career; their players are hashed as a sorted stream, which takes constant memory. Tasks hold ``run`` steps,
    or one career where that is longer, and a batch of careers. Steps are told apart by 128 bits of hash.
    """
    keyed = stored(own.select("sofifa_player_id", "steps", F.xxhash64("steps").alias("s1"), F.xxhash64(F.lit(1), "steps").alias("s2")))
    # A range holds part of a career with many players; only joined texts of such parts meet in one task, as SHA-256 needs them.
    players = keyed.select("s1", "s2", "sofifa_player_id")
    players = players.repartitionByRange(*players.columns).sortWithinPartitions(*players.columns)
    parts = players.mapInArrow(_joined_players, "s1 long, s2 long, least long, copies long, text string")
    parts = parts.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "least")
    ends = parts.mapInArrow(_digest_ends, "s1 long, s2 long, least long, copies long, ends string")
    distinct = keyed.groupBy("s1", "s2").agg(F.first("steps").alias("steps"))
    told = stored(distinct.join(ends, ["s1", "s2"]).select("steps", "least", "copies", "ends"))
    ordered = told.repartitionByRange("steps").sortWithinPartitions("steps").select("steps.a", "steps.b", "steps.points", "least", "copies", "ends")
    nodes = stored(ordered.mapInArrow(lambda batches: _sorted_runs(batches, run), _NODE))
    total = _joined_open(nodes)
    least = sized_broadcast(total.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("sofifa_player_id").alias("above")))
    closed = nodes.where("NOT open")
    under_open = closed.where("parent_player_id IS NULL").join(least, ["p1", "p2", "depth"]).withColumn("parent_player_id", F.col("above"))
    opened = total.join(least, ["p1", "p2", "depth"], "left").withColumn("parent_player_id", F.when(F.col("depth") > 0, F.col("above")))
    return closed.where("parent_player_id IS NOT NULL").select(*_RESULT).unionByName(under_open.select(*_RESULT)).unionByName(opened.select(*_RESULT))
