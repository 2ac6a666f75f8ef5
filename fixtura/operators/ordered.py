"""Order-dependent operators that never put a whole file or key in one task.

A sequence is split into chunks (a file split, a time bucket). What a row needs
from earlier chunks is carried by a small table with one row per chunk; what it
needs from its neighbours comes from chunks that overlap by a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``, by aggregation so a hot key combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def number_rows(df: DataFrame, sequence: str, chunk: str, position: str, name: str = "ordinal") -> DataFrame:
    """0-based ordinal of every row in its sequence, ordered by (chunk, position)."""
    counts = df.groupBy(sequence, chunk).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(sequence).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(sequence, chunk, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    in_chunk = F.row_number().over(W.partitionBy(sequence, chunk).orderBy(position)) - 1
    return (
        df.withColumn("_in_chunk", in_chunk)
        .join(starts, [sequence, chunk])
        .withColumn(name, (F.col("_start") + F.col("_in_chunk")).cast("bigint"))
        .drop("_start", "_in_chunk")
    )


def fill_forward(
    df: DataFrame, sequence: str, ordinal: str, columns: dict[str, Column], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Last non-NULL value so far of each column, never across sequences.

    ``columns`` names the outputs. Buckets of ``bucket_rows`` rows are filled on
    their own; the value open at a bucket's start comes from a per-bucket table.
    """
    work = df.withColumn("_bucket", F.floor(F.col(ordinal) / bucket_rows)).withColumns(
        {f"_in_{c}": expr for c, expr in columns.items()}
    )
    last_in_bucket = work.groupBy(sequence, "_bucket").agg(
        *[
            F.max_by(f"_in_{c}", F.when(F.col(f"_in_{c}").isNotNull(), F.col(ordinal))).alias(f"_end_{c}")
            for c in columns
        ]
    )
    earlier = W.partitionBy(sequence).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = last_in_bucket.select(
        sequence, "_bucket", *[F.last(f"_end_{c}", True).over(earlier).alias(f"_carry_{c}") for c in columns]
    )
    so_far = W.partitionBy(sequence, "_bucket").orderBy(ordinal).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = work.withColumns({f"_fill_{c}": F.last(f"_in_{c}", True).over(so_far) for c in columns})
    return filled.join(carried, [sequence, "_bucket"]).select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(f"_fill_{c}", f"_carry_{c}").alias(c) for c in columns],
    )


def with_neighbours(
    df: DataFrame, sequence: str, ordinal: str, value: str, offsets: dict[str, int], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``value`` of the row ``offset`` places away under each given name.

    Rows near a bucket edge are also sent to the adjoining bucket, so every look-around
    is a lag or lead inside one bounded group.
    """
    reach = max(abs(o) for o in offsets.values())
    if reach >= bucket_rows:
        raise ValueError("offsets must be shorter than a bucket")
    home = F.floor(F.col(ordinal) / bucket_rows)
    targets = F.array_distinct(
        F.array(
            F.floor((F.col(ordinal) - reach) / bucket_rows), home, F.floor((F.col(ordinal) + reach) / bucket_rows)
        )
    )
    spread = df.withColumn("_home", home).withColumn("_bucket", F.explode(targets))
    order = W.partitionBy(sequence, "_bucket").orderBy(ordinal)
    looked = spread.withColumns(
        {name: F.lead(value, o).over(order) if o >= 0 else F.lag(value, -o).over(order) for name, o in offsets.items()}
    )
    return looked.filter(F.col("_home") == F.col("_bucket")).drop("_home", "_bucket")


def latest_before(
    targets: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    value: str,
    bucket_days: int = 30,
) -> DataFrame:
    """Backward as-of lookup: per target the last history value dated at or before it.

    ``at`` is a date on both sides; among equal dates the highest ``order`` wins.
    History is reduced to one value per (key, date) first. A key's timeline is then
    cut into buckets whose last values are carried forward, so no task holds more
    than ``bucket_days`` dates of a key plus one row per bucket.
    """
    day = F.unix_date(F.col(at))
    daily = history.groupBy(*keys, at).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order) if order else F.lit(0)).alias("_v")
    )
    rows = daily.withColumn("_ask", F.lit(False)).unionByName(
        targets.select(*keys, at).distinct().withColumn("_ask", F.lit(True)), allowMissingColumns=True
    ).withColumn("_bucket", F.floor(day / bucket_days))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", F.last("_end", True).over(earlier).alias("_carry"))
    so_far = W.partitionBy(*keys, "_bucket").orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = (
        rows.withColumn("_so_far", F.last("_v", True).over(so_far))
        .filter("_ask")
        .join(carried, [*keys, "_bucket"])
        .select(*keys, at, F.coalesce("_so_far", "_carry").getField("v").alias(value))
    )
    return targets.join(found, [*keys, at], "left")


def value_pair(
    points: DataFrame, targets: DataFrame, entity: str, days_back: int, order: Sequence[str]
) -> DataFrame:
    """Latest value at ``as_of`` and ``days_back`` days before it, per target row; NULL if none.

    ``points`` is (entity, value_date, value, order); a month counts 30 days.
    """
    moments = F.array(
        F.struct(F.lit("recent").alias("moment"), F.col("as_of").alias("value_date")),
        F.struct(F.lit("past").alias("moment"), F.date_sub("as_of", days_back).alias("value_date")),
    )
    asked = targets.select(entity, "as_of", F.inline(moments))
    found = latest_before(asked, points, [entity], "value_date", order, "value")
    return found.groupBy(entity, "as_of").agg(
        *[F.max(F.when(F.col("moment") == m, F.col("value"))).alias(f"value_{m}") for m in ("recent", "past")]
    )
