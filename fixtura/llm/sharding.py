"""Placement of records on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prime, and large against any shard list this is meant for: shares then differ by at most one slot.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[str]:
    """Slot -> shard. Each shard walks its own permutation of the slots (a start and a step drawn from
    its name); the shards take turns, each claiming the first slot on its walk that is still free.

    Bounded by ``size`` and the shard list, never by the records. The order in which shards are listed
    does not matter; repeated names count once. Adding or removing a shard moves few other slots.
    """
    names = sorted(set(shards))
    if not names or any(not n for n in names):
        raise ValueError("shards must be non-empty names")
    if not _is_prime(size) or size < len(names):
        raise ValueError("size must be a prime no smaller than the number of shards")
    walks = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        walks.append([int.from_bytes(digest[:8], "big") % size, 1 + int.from_bytes(digest[8:], "big") % (size - 1)])
    table: list[str | None] = [None] * size
    left = size
    while left:
        for name, walk in zip(names, walks):
            while table[walk[0]] is not None:
                walk[0] = (walk[0] + walk[1]) % size
            table[walk[0]] = name
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table. A NULL key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(records: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Every record with its slot and shard.

    The slot table has ``size`` rows whatever the data, so it is broadcast and each record is placed by one
    hash and one lookup: no shuffle. Columns of ``records`` named like the two outputs are replaced. Equal
    keys always meet on one shard; NULL and empty keys share one; repeated rows stay; an empty table stays empty.
    """
    spark = records.sparkSession
    names = lookup_table(shards, size)
    table = spark.createDataFrame(list(enumerate(names)), f"`{slot}` int, `{shard}` string")
    kept = records.withColumn(slot, slot_of(F.col(f"`{key}`"), size)).drop(*([shard] if shard != key else []))
    return kept.join(F.broadcast(table), slot).select(*[f"`{c}`" for c in kept.columns if c != slot], f"`{slot}`", f"`{shard}`")


def shard_quotes(quotes: DataFrame, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Match-odds records (``odds_id`` and any further fields) with ``slot`` and ``shard``; see ``place``."""
    return place(quotes, "odds_id", shards, size)
