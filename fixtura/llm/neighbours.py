"""Nearest players by their attribute vectors: one navigable small-world graph per shard, shard results merged.

A graph is flat arrays (neighbours of every node at the ground level; nodes and neighbours of each upper level), one row
per shard in the stored index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.llm.store import stored

SHARD_VECTORS = 8_192
QUERY_BLOCK = 1_024
LINKS = 12
BUILD_WIDTH = 64
SEARCH_WIDTH = 160


@dataclass
class Graph:
    """``ground``: node x neighbour at level 0 (-1 is none). ``upper``: per level above, its nodes and their neighbours."""

    vectors: np.ndarray
    ground: np.ndarray
    upper: list[tuple[np.ndarray, np.ndarray]]
    entry: int

    def neighbours(self, node: int, level: int) -> np.ndarray:
        if level == 0:
            row = self.ground[node]
        else:
            nodes, links = self.upper[level - 1]
            row = links[np.searchsorted(nodes, node)]
        return row[row >= 0]


def _walk(q: np.ndarray, start: list[tuple[float, int]], width: int, vectors: np.ndarray, seen: np.ndarray, stamp: int, around) -> list[tuple[float, int]]:
    """Best-first search of one level: the ``width`` nearest found, nearest first."""
    front = list(start)
    heapq.heapify(front)
    best = [(-d, i) for d, i in start]
    heapq.heapify(best)
    for _, i in start:
        seen[i] = stamp
    while front:
        d, node = heapq.heappop(front)
        if d > -best[0][0] and len(best) >= width:
            break
        near = around(node)
        near = near[seen[near] != stamp]
        if not len(near):
            continue
        seen[near] = stamp
        gap = vectors[near] - q
        dist = np.einsum("ij,ij->i", gap, gap)
        if len(best) >= width:
            close = dist < -best[0][0]
            near, dist = near[close], dist[close]
        for e, i in zip(dist.tolist(), near.tolist()):
            if len(best) < width:
                heapq.heappush(best, (-e, i))
            elif e < -best[0][0]:
                heapq.heapreplace(best, (-e, i))
            else:
                continue
            heapq.heappush(front, (e, i))
    return sorted((-d, i) for d, i in best)


def _spread(found: list[tuple[float, int]], vectors: np.ndarray, most: int) -> list[int]:
    """Up to ``most`` of the found, nearest first, leaving out nodes nearer to a chosen one than to the query, then filling up."""
    ids = np.array([i for _, i in found])
    v = vectors[ids]
    norm = np.einsum("ij,ij->i", v, v)
    between = norm[:, None] + norm[None, :] - 2 * v @ v.T
    chosen: list[int] = []
    covered = np.zeros(len(ids), bool)
    own = np.array([d for d, _ in found])
    for k in range(len(ids)):
        if not covered[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            covered |= between[k] < own
    for k in range(len(ids)):
        if len(chosen) == most:
            break
        if covered[k] and k not in chosen:
            chosen.append(k)
    return ids[sorted(chosen)].tolist()


def build_graph(vectors: np.ndarray, seed: int) -> Graph:
    """Insert distinct vectors one by one; a node's top level is geometric. Needs at least one vector."""
    n = len(vectors)
    vectors = vectors.astype(np.float32)
    tops = np.minimum((-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(LINKS)).astype(int), 8)
    width = [2 * LINKS * 3 // 2] + [LINKS * 3 // 2] * int(tops.max())
    keep = [2 * LINKS] + [LINKS] * int(tops.max())
    tables = [np.full((n, w) if k == 0 else (int((tops >= k).sum()), w), -1, np.int32) for k, w in enumerate(width)]
    place = [np.arange(n)] + [np.cumsum(tops >= k) - 1 for k in range(1, len(width))]
    degree = [np.zeros(len(t), np.int32) for t in tables]
    seen = np.full(n, -1, np.int64)

    def around(level: int):
        table, at, deg = tables[level], place[level], degree[level]
        return lambda node: table[at[node], : deg[at[node]]]

    entry, stamp = 0, 0
    for i in range(1, n):
        q, top = vectors[i], int(tops[i])
        gap = vectors[entry] - q
        found = [(float(gap @ gap), entry)]
        for level in range(int(tops[entry]), -1, -1):
            stamp += 1
            found = _walk(q, found, BUILD_WIDTH if level <= top else 1, vectors, seen, stamp, around(level))
            if level > top:
                continue
            table, at, deg = tables[level], place[level], degree[level]
            mine = _spread(found, vectors, LINKS)
            row = at[i]
            table[row, : len(mine)] = mine
            deg[row] = len(mine)
            for j in mine:
                r = at[j]
                if deg[r] == width[level]:
                    old = table[r]
                    gaps = vectors[old] - vectors[j]
                    dist = np.einsum("ij,ij->i", gaps, gaps)
                    order = np.argsort(dist, kind="stable")
                    kept = _spread([(float(dist[k]), int(old[k])) for k in order], vectors, keep[level])
                    table[r] = -1
                    table[r, : len(kept)] = kept
                    deg[r] = len(kept)
                table[r, deg[r]] = i
                deg[r] += 1
        if top > tops[entry]:
            entry = i
    return Graph(vectors, tables[0], [(np.flatnonzero(tops >= k), t) for k, t in enumerate(tables) if k], entry)


def search_graph(graph: Graph, q: np.ndarray, most: int, seen: np.ndarray, stamp: int) -> tuple[list[int], int]:
    """Nodes found nearest to ``q``, and the next unused stamp."""
    q = q.astype(np.float32)
    gap = graph.vectors[graph.entry] - q
    found = [(float(gap @ gap), graph.entry)]
    for level in range(len(graph.upper), -1, -1):
        stamp += 1
        width = max(SEARCH_WIDTH, most) if level == 0 else 1
        found = _walk(q, found, width, graph.vectors, seen, stamp, lambda node, level=level: graph.neighbours(node, level))
    return [i for _, i in found], stamp


def usable(vector: str = "attributes"):
    """Neither NULL nor empty nor all zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(players: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(graphs, members) over every usable row with a ``player_id``.

    Equal vectors are one node. Members: ``node`` (the smallest id of a vector), ``player_id``, for the ``most`` smallest ids
    of each vector, which is all that a list of that length can show. Graphs: ``shard``, ``width`` and the flat arrays.
    """
    rows = players.where("player_id IS NOT NULL").where(usable()).select("player_id", F.col("attributes").cast("array<double>").alias("attributes")).distinct()
    by = W.partitionBy("attributes").orderBy("player_id")
    ranked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    members = stored(ranked.withColumn("node", F.min("player_id").over(W.partitionBy("attributes"))))
    nodes = members.where("rank = 1").select("node", "attributes", F.size("attributes").alias("width"))
    shards = nodes.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / SHARD_VECTORS).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "width").withColumn("shard", F.pmod(F.xxhash64("attributes"), F.col("shards")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        exact = np.stack(rows["attributes"].to_numpy()).astype(np.float64)
        g = build_graph(exact, int(rows["shard"].iloc[0]))
        return pd.DataFrame({
            "width": [exact.shape[1]], "shard": [int(rows["shard"].iloc[0])], "nodes": [rows["node"].to_numpy(np.int64).tobytes()],
            "vectors": [exact.tobytes()], "ground": [g.ground.tobytes()], "entry": [g.entry],
            "upper_nodes": [[a.astype(np.int32).tobytes() for a, _ in g.upper]], "upper_links": [[b.tobytes() for _, b in g.upper]],
        })

    graphs = dealt.groupBy("width", "shard").applyInPandas(
        build, "width int, shard int, nodes binary, vectors binary, ground binary, entry int, upper_nodes array<binary>, upper_links array<binary>"
    )
    return stored(graphs), members.select("node", "player_id")


def _load(row) -> tuple[np.ndarray, np.ndarray, Graph]:
    nodes = np.frombuffer(row.nodes, np.int64)
    exact = np.frombuffer(row.vectors, np.float64).reshape(len(nodes), -1)
    ground = np.frombuffer(row.ground, np.int32).reshape(len(nodes), -1)
    upper = [(a := np.frombuffer(x, np.int32), np.frombuffer(y, np.int32).reshape(len(a), -1)) for x, y in zip(row.upper_nodes, row.upper_links)]
    return nodes, exact, Graph(exact.astype(np.float32), ground, upper, int(row.entry))


def search_index(graphs: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, player_id, score): per query its ``k`` nearest found members but itself, ties to the smaller id.

    Queries go to every shard of their width in blocks of QUERY_BLOCK; a shard answers with k + 1 nodes, measured exactly.
    """
    asked = queries.where("player_id IS NOT NULL").where(usable()).select(
        F.col("player_id").alias("query_id"), F.col("attributes").cast("array<double>").alias("q"), F.size("attributes").alias("width")
    ).dropDuplicates(["query_id", "q"])
    blocks = max(1, asked.count() // QUERY_BLOCK)
    packed = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy("width", "block").agg(
        F.collect_list(F.struct("query_id", "q")).alias("asked")
    )
    parts = max(1, graphs.count()) * blocks
    pairs = graphs.join(packed, "width").repartition(parts, "shard", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                nodes, exact, graph = _load(row)
                seen, stamp = np.full(len(nodes), -1, np.int64), 0
                out = []
                for a in row.asked:
                    q = np.asarray(a["q"], float)
                    ids, stamp = search_graph(graph, q, k + 1, seen, stamp)
                    score = np.sqrt(((exact[ids] - q) ** 2).sum(axis=1))
                    order = np.lexsort((nodes[ids], score))[: k + 1]
                    out += [(a["query_id"], int(nodes[ids[i]]), float(score[i])) for i in order]
                yield pd.DataFrame(out, columns=["query_id", "node", "score"])

    found = pairs.mapInPandas(search, "query_id long, node long, score double")
    best = W.partitionBy("query_id").orderBy("score", "node")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    near = top.join(members, F.col("node") == F.col("member_node")).where("player_id <> query_id")
    last = W.partitionBy("query_id").orderBy("score", "player_id")
    return near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "player_id", "score")


def nearest_players(players: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` players nearest to each query by Euclidean distance of ``attributes``, by the sharded graph index.

    ``players`` and ``queries``: ``player_id`` and ``attributes`` (an array of numbers, e.g. overall, potential, age, height).
    Returns ``query_id``, ``rank`` from 1, ``player_id`` and ``score``, the distance in double precision on the given vectors.

    Vectors that are NULL, empty, all zero or hold NULL, NaN or infinite components take no part, nor do rows without a
    key. Vectors of different length are not comparable. A query is never its own neighbour, a player with the same vector
    is, at distance 0. Fewer candidates than ``k`` give fewer rows; repeated rows count once; a key with several vectors is
    found by each of them. The search is approximate: nearly all, not all, of the true neighbours are found.
    """
    graphs, members = build_index(players, k + 1)
    return search_index(graphs, members.withColumnRenamed("node", "member_node"), queries, k)
