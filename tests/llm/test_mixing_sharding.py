"""Replication rates and placement against plain Python and SQL."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtura.llm import mixing, sharding
from fixtura.llm.queries import CHECKS, QUERIES, SHARDS
from workload.compare import differences


def _count(seed, key, rate):
    """Poisson by inversion, part by part."""
    total, j = 0, 0
    parts = [rate - math.floor(rate / mixing.PART) * mixing.PART] + [mixing.PART] * math.floor(rate / mixing.PART)
    for j, mean in enumerate(parts):
        u = int(hashlib.md5(f"{seed}|{'' if key is None else key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean)
        for k in range(1, mixing.STEPS + 2):
            if c > u:
                break
            total += 1
            p *= mean / k
            c += p
    return total


def test_counts_and_rates(spark):
    rows = [(i, "hot", "x") for i in range(300)] + [(1000 + i, "small", None) for i in range(10)] + [(2000 + i, None, "z") for i in range(20)]
    rows += [(5000, "unwanted", "q"), (None, "hot", "n"), (1000, "small", "again")]
    df = spark.createDataFrame(rows, "odds_id long, source string, _mix_n string").withColumn("copy", F.lit("c"))
    targets = spark.createDataFrame([("hot", 1.0), ("small", 1.0), ("small", 1.5), (None, 0.5), ("absent", 9.0), ("unwanted", -3.0)], "source string, weight double")
    got = mixing.mix_quotes(df, targets, seed=3).collect()
    have = Counter(s for _, s, _ in rows)
    weights = {"hot": 1.0, "small": 2.5, None: 0.5, "unwanted": 0.0}
    rates = {s: w / 4.0 * len(rows) / have[s] for s, w in weights.items()}
    want = Counter()
    for k, s, extra in rows:
        for c in range(_count(3, k, rates[s]) if rates[s] else 0):
            want[k, s, extra, c + 1] += 1
    assert Counter((r.odds_id, r.source, r["_mix_n"], r["copy"]) for r in got) == want
    assert rates["small"] > mixing.PART


def test_mixture_meets_its_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("odds_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mix_quotes(df, targets, rows=40_000).groupBy("source").count().collect()}
    assert abs(n["a"] / 30_000 - 1) < 0.03 and abs(n["b"] / 10_000 - 1) < 0.05


def test_order_is_global(spark):
    df = spark.range(4_000).select(F.col("id").alias("odds_id"), F.lit("a").alias("source"))
    targets = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    ids = [r.odds_id for r in mixing.mix_quotes(df, targets).collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < rising < 0.6


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([(1, "a")], "odds_id long, source string")
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix_quotes(df, none).count() == 0
    assert mixing.mix_quotes(df.limit(0), none.union(spark.createDataFrame([("a", 1.0)], "source string, weight double"))).count() == 0


def test_mixing_query_matches_sql(spark, sf_dir):
    name = "op3_source_mixing"
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), CHECKS[name], sf_dir) is None


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(9)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(names) and max(counts.values()) - min(counts.values()) <= 1
    assert table == sharding.lookup_table(names[::-1] + ["s0"], 1009)
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != "s8") / 1009
    assert moved < 0.25
    # Turn by turn, every claim takes the first free slot of the walk.
    walks = {}
    for n in sorted(names):
        d = hashlib.md5(n.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % 1009, 1 + int.from_bytes(d[8:], "big") % 1008
        walks[n] = iter([(start + i * step) % 1009 for i in range(1009)])
    want = {}
    while len(want) < 1009:
        for n in sorted(names):
            if len(want) < 1009:
                want[next(s for s in walks[n] if s not in want)] = n
    assert table == [want[i] for i in range(1009)]


def test_bad_shard_lists():
    for shards, size in (([], 7), ([""], 7), (["a"], 8), (list("abc"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_placement(spark, sf_dir):
    df = spark.createDataFrame([(1, "a", "old"), (None, "b", "old"), (1, "c", "old")], "odds_id long, source string, shard string")
    rows = sharding.shard_quotes(df, ["x", "y"], 101).collect()
    assert len(rows) == 3 and rows[0].shard in ("x", "y") and len({r.slot for r in rows if r.odds_id == 1}) == 1
    assert sharding.shard_quotes(df.limit(0), ["x"], 101).count() == 0
    table = sharding.lookup_table(SHARDS)
    for r in QUERIES["op6_sharding"](spark, sf_dir).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, table[slot])
