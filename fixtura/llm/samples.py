"""Bounded samples of labelled records, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.store import small_batches, stored

# Parts that a stored sample is dealt over; the sample is bounded, so this need not grow.
PARTS = 24


def labelled_sample(records: DataFrame, judgements: DataFrame, key: str, text: str, label: str, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` judged records, those with the smallest hash of their key.

    Rows without a label (0 or 1) or key do not count; of contradictory labels of one key the larger holds. Only the
    chosen keys, at most ``limit``, are broadcast; the records are read once and do not move.
    """
    small_batches(records.sparkSession)
    judged = (
        judgements.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where("key IS NOT NULL AND label IN (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    )
    chosen = judged.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(limit)
    rows = records.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(rows.join(F.broadcast(chosen), "key").select("text", "label").repartition(PARTS))
