"""Typed readers and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura import schemas
from fixtura.functions.names import safe_double, safe_int, safe_text
from fixtura.functions.weights import day_number


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_contests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Contest table with the derived integer day."""
    reader = spark.read.schema(schemas.CONTESTS).option("header", True)
    return reader.format(fmt).load(path).withColumn("day", day_number(F.col("match_date")))


def read_renames(spark: SparkSession, path: str) -> DataFrame:
    """Rename history numbered in file order, which decides between overlapping rows."""
    return read_csv(spark, path, schemas.FORMER_NAMES).withColumn("row_no", F.monotonically_increasing_id())


def read_strings(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """CSV with every field as text; a missing required column is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(df.columns, required, path)
    return df


def require_columns(present: Iterable[str], required: Iterable[str], where: str) -> None:
    missing = [c for c in required if c not in set(present)]
    if missing:
        raise ValueError(f"{where} lacks required column(s) {missing}")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """The 18 rating columns in use, cast safely, out of a much wider file."""
    kinds = {T.IntegerType(): safe_int, T.DoubleType(): safe_double, T.StringType(): safe_text}
    raw = read_strings(spark, path, schemas.RATINGS_SOURCE.names)
    typed = raw.select(*[kinds[f.dataType](F.col(f.name)).alias(f.name) for f in schemas.RATINGS_SOURCE])
    return typed.withColumnsRenamed(
        {"player_id": "sofifa_player_id", "update_as_of": "rating_date", "dob": "date_of_birth"}
    )


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_with_backup(df: DataFrame, path: str, backup: str) -> bool:
    """Copy what is stored at ``path`` to CSV before overwriting it; True if there was something.

    ``df`` must not read from ``path``: Spark cannot overwrite what it is reading.
    """
    try:
        stored = df.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        replace_table(df, path)
        return False
    stored.write.mode("overwrite").option("header", True).csv(backup)
    replace_table(df, path)
    return True


def write_queue(df: DataFrame, path: str) -> None:
    """CSV sink for review queues and trial logs; an empty frame replaces a stale file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_proposal(df: DataFrame, path: str) -> None:
    df.select(*schemas.PROPOSAL.names).write.mode("overwrite").json(path)


def read_proposal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROPOSAL).json(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
