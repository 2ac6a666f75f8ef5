"""Corpus preparation from raw documents to placed shards: five stages, each a decision that takes effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.llm import jaccard, leaks, mixing, sharding, toxicity
from fixtura.llm.queries import MIX_EXPONENT, MIX_SEED, SHARDS, judged, pages
from fixtura.llm.store import stored

TOXIC = 0.7
# Near-copies share this percentage of their sets of COPY_WORDS words; op2_ngram_jaccard has values of its own.
COPY_WORDS = 5
COPY_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC. Nothing moves: the score is a column of the scan."""
    model = toxicity.fit_toxicity(pages(docs), judged(spark, sf_dir))
    return docs.where(toxicity.toxicity(F.col("text"), model, spark) < TOXIC)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one with the smallest doc_id."""
    return jaccard.keep_one_of_copies(docs, "doc_id", "text", COPY_WORDS, COPY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Rows without a doc_id are judged like any other."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("wiki_page"), F.col("text").alias("page_text"))
    return leaks.without_leaks(docs, "text", items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to tempered weights of their sources, in a global hash order."""
    targets = mixing.tempered_targets(docs.select("source"), MIX_EXPONENT)
    return mixing.replicate(docs, "doc_id", "source", targets, MIX_SEED, copy=None)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``slot`` and ``shard``."""
    return sharding.place(docs, "doc_id", SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_on_shards),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
