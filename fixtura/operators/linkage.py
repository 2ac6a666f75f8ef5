"""Blocked record linkage: people of one source to rated people of another.

A target is compared with the candidates of its block. An equal birth date
outranks any name score; among equals the higher score wins, then the earlier
candidate. High tier needs both signals, medium is for review, the rest is unlinked.

A block may be huge, so nothing compares every target with every candidate in it:

* names are compared once per distinct token set, and rows join the answer back;
* scores that depend only on shared tokens come from equi-joins on token subsets,
  against a candidate side already reduced to one row per subset;
* without a birth-date match only scores of at least 0.9 count, and such pairs
  share one of a few rare letter pairs of each name, which is the join key;
* with a birth-date match any score from 0.55 counts, so those names are compared
  within (block, birth date), cut into salted parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.functions.names import key_similarity, name_key, token_set
from fixtura.operators.form import union_all
from fixtura.runtime import materialise, sized_broadcast, spread_out

HIGH, MEDIUM = 0.90, 0.55
SUBSET_TOKENS = 8
PART_NAMES = 2_000

# Fixed value: the one nationality the two sources spell differently.
NATIONALITY_ALIASES = {"South Korea": "Korea Republic"}


def block_nationality(country: Column, aliases: dict[str, str] = NATIONALITY_ALIASES) -> Column:
    expr = country
    for source, target in aliases.items():
        expr = F.when(country == source, F.lit(target)).otherwise(expr)
    return expr


def tier(score: Column, dob_match: Column) -> Column:
    return F.when(dob_match & (score >= HIGH), "high").when(
        (dob_match & (score >= MEDIUM)) | (~dob_match & (score >= HIGH)), "medium"
    )


def _token_string(name: str) -> Column:
    return F.concat_ws(" ", token_set(name_key(F.col(name))))


def _birthday(unknown: str) -> Column:
    """Date as text; the marker keeps unknown dates joinable yet unequal across sources."""
    return F.coalesce(F.col("dob").cast("string"), F.lit(unknown))


def _tokens() -> Column:
    return F.split(F.col("name"), " ")


def _is_long() -> Column:
    return F.size(_tokens()) > SUBSET_TOKENS


def _with_subsets(df: DataFrame) -> DataFrame:
    """One row per non-empty token subset of each short name, with its share of the name."""
    grown = F.aggregate(
        _tokens(),
        F.array(F.lit("")),
        lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.when(s == "", t).otherwise(F.concat(s, F.lit(" "), t)))),
    )
    rows = df.filter(~_is_long()).withColumn("subset", F.explode(F.filter(grown, lambda s: s != "")))
    size = F.length("subset")
    return rows.withColumn("share", 2.0 * size / (size + F.length("name")))


def _best(scored: DataFrame, ask: Sequence[str]) -> DataFrame:
    top = F.min(F.struct((-F.col("score")).alias("loss"), F.col("first"))).alias("_b")
    return scored.groupBy(*ask).agg(top).select(*ask, (-F.col("_b.loss")).alias("score"), F.col("_b.first").alias("first"))


def _subset_scores(asks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Best score of at least HIGH that shared whole tokens alone can give, per ask."""
    ask = [*keys, "name"]
    ask_sets, name_sets = _with_subsets(asks.select(*ask)), _with_subsets(names.select(*ask, "first"))
    any_holder = name_sets.groupBy(*keys, "subset").agg(F.min("first").alias("first"))
    best_holder = (
        name_sets.filter(F.col("share") >= HIGH)
        .groupBy(*keys, "subset")
        .agg(F.min(F.struct((-F.col("share")).alias("loss"), F.col("first"))).alias("_b"))
        .select(*keys, "subset", (-F.col("_b.loss")).alias("score"), F.col("_b.first").alias("first"))
    )
    by_ask = (
        ask_sets.filter(F.col("share") >= HIGH)
        .join(any_holder, [*keys, "subset"])
        .select(*ask, F.col("share").alias("score"), "first")
    )
    by_name = ask_sets.join(best_holder, [*keys, "subset"]).select(*ask, "score", "first")
    return _best(by_ask.unionByName(by_name), ask)


def _rare_pairs(df: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    """The rarest letter pairs of each name, enough that any name scoring HIGH shares one.

    One inserted or deleted letter removes at most two letter pairs, and a score of
    HIGH allows ``(1-HIGH)`` edits per letter of both names together.
    """
    reach = F.floor(F.length("name") * (1 - HIGH) * (1 + (2 - HIGH) / HIGH) + 1e-9)
    ranked = _letter_pairs(df).join(frequency, "pair")
    order = W.partitionBy(*keys, "name").orderBy("uses", "pair")
    return ranked.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= 2 * reach + 1).drop("_rank", "uses")


def _letter_pairs(df: DataFrame) -> DataFrame:
    padded = F.concat(F.lit(" "), F.col("name"), F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length("name") + 1), lambda i: F.substr(padded, i, F.lit(2)))
    numbered = F.transform(
        pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).cast("string"))
    )
    return df.withColumn("pair", F.explode(numbered))


def _near_pairs(asks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of distinct names that may reach HIGH by letters, joined on a rare letter pair."""
    uses = _letter_pairs(names.select(*keys, "name")).groupBy("pair").agg(F.count(F.lit(1)).alias("uses"))
    known = _letter_pairs(asks.select(*keys, "name")).select("pair").distinct()
    frequency = sized_broadcast(
        known.join(uses, "pair", "full_outer").select("pair", F.coalesce("uses", F.lit(0)).alias("uses"))
    )
    left = _rare_pairs(asks.select(*keys, "name"), keys, frequency)
    right = _rare_pairs(names.select(*keys, "name", "first"), keys, frequency).withColumnRenamed("name", "other")
    longest = (2 - HIGH) / HIGH
    return (
        left.join(right, [*keys, "pair"])
        .filter(F.length("other").between(F.length("name") / longest, F.length("name") * longest))
        .select(*keys, "name", "other", "first")
        .distinct()
    )


def _group_pairs(asks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """All (ask, name) of a group, with large groups cut into parts of PART_NAMES names."""
    parts = names.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_NAMES).alias("_parts"))
    right = (
        names.join(parts, keys)
        .withColumn("_part", F.pmod(F.xxhash64("name"), F.col("_parts")))
        .select(*keys, "_part", F.col("name").alias("other"), "first")
    )
    left = asks.join(parts, keys).select(
        *keys, "name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part")
    )
    return left.join(right, [*keys, "_part"]).select(*keys, "name", "other", "first")


def _scored(pairs: DataFrame, ask: list[str], least: float) -> DataFrame:
    scored = pairs.withColumn("score", key_similarity(F.col("name"), F.col("other"))).filter(F.col("score") >= least)
    return _best(scored, ask)


def _with_long_names(asks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs in which a side has too many tokens for subset rows."""
    long_asks = _group_pairs(asks.filter(_is_long()), names, keys)
    long_names = _group_pairs(asks.filter(~_is_long()), names.filter(_is_long()), keys)
    return long_asks.unionByName(long_names)


def best_candidates(targets: DataFrame, candidates: DataFrame, blocks: list[str]) -> DataFrame:
    """(target_id, candidate_no, name_score, dob_match, tier) of each linked target.

    ``targets`` is (target_id, *blocks, player_name, dob); ``candidates`` is
    (candidate_no, *blocks, short_name, long_name, dob), numbered in source order.
    """
    # Names are cleaned in Python and both sides are read by every branch below, so each is spread over all cores, cleaned
    # and stored once; a small file is read by one task.
    targets = spread_out(targets.select("target_id", *blocks, "player_name", "dob"))
    candidates = spread_out(candidates.select("candidate_no", *blocks, "short_name", "long_name", "dob"))
    asked = materialise(
        targets.select("target_id", *blocks, _birthday("no target date").alias("dob"), _token_string("player_name").alias("name"))
    )
    named = candidates.select(
        *blocks,
        _birthday("no candidate date").alias("dob"),
        F.col("candidate_no").alias("first"),
        F.explode(F.array(_token_string("short_name"), _token_string("long_name"))).alias("name"),
    )
    born = [*blocks, "dob"]
    held = materialise(named.groupBy(*born, "name").agg(F.min("first").alias("first")))
    names = held.filter(F.col("name") != "")
    asks = materialise(asked.filter(F.col("name") != "").select(*born, "name").distinct())
    dated = held.select(*born).distinct()
    with_dob = asks.join(dated, born, "left_semi")
    without = asks.join(dated, born, "left_anti")

    same_day = _subset_scores(with_dob, names, born)
    settled = same_day.filter(F.col("score") == 1.0)
    open_asks = with_dob.join(settled, [*born, "name"], "left_anti")
    same_day = _best(
        union_all(
            [
                settled,
                _scored(_group_pairs(open_asks, names, born), [*born, "name"], MEDIUM),
                _scored(_with_long_names(settled.select(*born, "name"), names, born), [*born, "name"], MEDIUM),
            ]
        ),
        [*born, "name"],
    )

    block_names = names.groupBy(*blocks, "name").agg(F.min("first").alias("first"))
    block_asks = without.select(*blocks, "name").distinct()
    other_day = _best(
        union_all(
            [
                _subset_scores(block_asks, block_names, blocks),
                _scored(_near_pairs(block_asks, block_names, blocks), [*blocks, "name"], HIGH),
                _scored(_with_long_names(block_asks, block_names, blocks), [*blocks, "name"], HIGH),
            ]
        ),
        [*blocks, "name"],
    )
    found = same_day.withColumn("dob_match", F.lit(True)).unionByName(
        without.join(other_day, [*blocks, "name"]).withColumn("dob_match", F.lit(False))
    )
    return asked.join(found, [*born, "name"]).select(
        "target_id",
        F.col("first").alias("candidate_no"),
        F.col("score").alias("name_score"),
        "dob_match",
        tier(F.col("score"), F.col("dob_match")).alias("tier"),
    )


def apply_links(players: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Write high-tier links into the player rows; other rows keep what they had."""
    fresh = (
        links.filter(F.col("tier") == "high")
        .join(candidates.select("candidate_no", "candidate_id"), "candidate_no")
        .select(
            F.col("target_id").alias("player_appearance_id"),
            F.col("candidate_id").alias("_id"),
            F.col("name_score").alias("_score"),
            F.col("tier").alias("_tier"),
        )
    )
    columns = {"sofifa_player_id": "_id", "rating_match_score": "_score", "rating_match_tier": "_tier"}
    return (
        players.join(fresh, "player_appearance_id", "left")
        .withColumns({old: F.coalesce(new, old) for old, new in columns.items()})
        .select(*players.columns)
    )


def review_queue(targets: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Medium-tier links with both records side by side."""
    return (
        links.filter(F.col("tier") == "medium")
        .join(targets.withColumnRenamed("dob", "target_dob"), "target_id")
        .join(candidates.select("candidate_no", "short_name", "long_name", F.col("dob").alias("candidate_dob")), "candidate_no")
        .select(
            "target_id", "player_name", "target_dob", "candidate_no", "short_name", "long_name", "candidate_dob",
            F.round("name_score", 3).alias("name_score"),
        )
    )


def coverage(targets: DataFrame, links: DataFrame, group: str) -> DataFrame:
    """Per group and in total: targets, high, review, unlinked, share of high."""
    tagged = targets.select("target_id", group).join(links.select("target_id", "tier"), "target_id", "left")
    return tagged.rollup(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("tier") == "high").alias("high"),
        F.count_if(F.col("tier") == "medium").alias("review"),
        F.count_if(F.col("tier").isNull()).alias("unlinked"),
        (F.count_if(F.col("tier") == "high") / F.count(F.lit(1))).alias("coverage"),
    )
