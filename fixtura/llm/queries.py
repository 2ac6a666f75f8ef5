"""Queries of the corpus operators: each maps the given tables to an operator's records and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.llm import careers, checks, fluency, jaccard, languages, leaks, lines, mixing, neighbours, pseudonyms, quality, sharding, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

SHARDS = [f"shard-{i:03d}" for i in range(97)]
MIX_EXPONENT = 0.5
MIX_SEED = 7


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def pages(docs: DataFrame) -> DataFrame:
    """Documents as roster pages."""
    return docs.select(F.col("doc_id").alias("tournament_id"), F.col("text").alias("page_text"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from."""
    return table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1).withColumnRenamed("doc_id", "tournament_id")


def scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select(
        F.col("tournament_id").alias("doc_id"), (remainder("tournament_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op1_toxicity")
def _(s: SparkSession, d: str) -> DataFrame:
    return scored(toxicity.score_pages(pages(table(s, d, "documents")), judged(s, d)), 0.7)


@query("op3_source_mixing", checks.MIXING.format(exponent=MIX_EXPONENT, seed=MIX_SEED, part=mixing.PART, steps=mixing.STEPS))
def _(s, d):
    quotes = table(s, d, "documents").select(F.col("doc_id").alias("odds_id"), "source")
    mixed = mixing.mix_quotes(quotes, mixing.tempered_targets(quotes, MIX_EXPONENT), MIX_SEED)
    return mixed.select(F.col("odds_id").alias("doc_id"), "source", F.col("copy").cast("bigint").alias("copy"))


@query("op4_quality")
def _(s, d):
    return scored(quality.score_quality(pages(table(s, d, "documents")), judged(s, d)), 0.5)


@query("op6_sharding")
def _(s, d):
    quotes = table(s, d, "documents").select(F.col("doc_id").alias("odds_id"), "source")
    placed = sharding.shard_quotes(quotes, SHARDS)
    return placed.select(F.col("odds_id").alias("doc_id"), F.col("slot").cast("bigint").alias("slot"), "shard")


@query("op8_decontamination", checks.LEAKS)
def _(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("wiki_page"), F.col("text").alias("page_text"))
    found = leaks.find_leaks(pages(table(s, d, "documents")), items)
    return found.select(
        F.col("tournament_id").alias("doc_id"), "n_words", "n_hit", F.size("leaked").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leaked", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_language_id")
def _(s, d):
    names = table(s, d, "documents").select(
        F.col("doc_id").alias("player_id"), F.col("text").alias("long_name"), F.col("lang").alias("nationality_name")
    )
    guess = languages.predict_nationality(names.drop("nationality_name"), names.where(remainder("player_id", 4) != 2))
    return guess.select(
        F.col("player_id").alias("doc_id"), (remainder("player_id", 4) == 2).alias("held_out"),
        F.col("nationality_pred").alias("lang_pred"), "score",
    )


@query("op2_ngram_jaccard")
def _(s, d):
    found = jaccard.page_copies(pages(table(s, d, "documents")))
    return found.select(F.col("tournament_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "n_links")


@query("op7_nearest_neighbours")
def _(s, d):
    players = table(s, d, "embeddings").select(F.col("vec_id").alias("player_id"), F.col("embedding").alias("attributes"))
    near = neighbours.nearest_players(players, players.where("player_id % 100 = 0"))
    return near.select("query_id", "rank", F.col("player_id").alias("vec_id"), "score")


PSEUDONYM_KEY = "production-key-1"


@query("op9_pseudonyms")
def _(s, d):
    done = pseudonyms.pseudonymise_pages(pages(table(s, d, "documents")), PSEUDONYM_KEY)
    return done.select(F.col("tournament_id").alias("doc_id"), F.col("page_text").alias("text"), "n_replaced")


@query("op5_line_dedup")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("position", "line"))
    marks = lines.mark_repeats(rows)
    return marks.select(
        F.col("file").alias("doc_id"), F.col("position").cast("bigint").alias("position"), F.col("first_file").alias("first_doc_id"),
        F.col("first_position").cast("bigint").alias("first_position"), "keep",
    )


# Turns that a rebuilt conversation may take from another one.
MOST_BORROWED = 5


@query("op11_prefix_trie", checks.PREFIX_TRIE)
def _(s, d):
    """Conversations as careers: a turn is an appearance, its role the position and its text the club."""
    turns = table(s, d, "conversations").select(
        F.col("conv_id").alias("sofifa_player_id"), F.col("turn").alias("year"), F.col("role").alias("position"), F.col("text").alias("club")
    )
    c = F.col("sofifa_player_id")
    rebuilt = careers.with_borrowed_starts(careers.careers(turns), c - c % 100, remainder("sofifa_player_id", MOST_BORROWED + 1), MOST_BORROWED)
    return careers.career_trie(rebuilt).select(
        F.col("sofifa_player_id").alias("conv_id"), "depth", F.col("parent_player_id").alias("parent_conv_id"), F.col("n_players").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_points").alias("saved_tokens"), "ends_sha256",
    )


@query("op12_whitening")
def _(s, d):
    players = table(s, d, "embeddings").select(F.col("vec_id").alias("player_id"), F.col("embedding").alias("attributes"))
    return whitening.whiten_players(players).select(
        F.col("player_id").alias("vec_id"), "component", "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained", "identity_error"
    )


@query("op13_lm_scoring")
def _(s, d):
    found = fluency.page_fluency(pages(table(s, d, "documents")), remainder("tournament_id", 7) != 2)
    return found.select(
        F.col("tournament_id").alias("doc_id"), (remainder("tournament_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
