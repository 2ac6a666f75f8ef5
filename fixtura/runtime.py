"""Session set-up and the two plan helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after a count shows at most this many rows.
SMALL_SIDE_ROWS = 100_000


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "fixtura") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sized_broadcast(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if counting it proves it small.

    Beyond the bound the join shuffles, whatever size Spark estimates, and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if df.count() <= max_rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Keep ``df`` from being broadcast by its estimated size.

    The estimate of a generated or compressed table can be a small part of what a
    hash table of its rows takes on the driver.
    """
    return df.hint("merge")


def with_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with added columns, each worked out once a row.

    A plain column is copied into every expression that reads it, and a filter on one moves below joins and aggregations,
    where it is worked out for rows that are yet to be put together. Neither happens to what a generator makes.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="fixtura-checkpoint-")
    sc.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_once(df: DataFrame) -> DataFrame:
    """A checkpointed copy split evenly, for a table that one job reads several times."""
    return materialise(df.hint("rebalance"))


def written(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet under the checkpoint folder. A reader decodes the columns it asks for and no others.

    Spark deletes shuffle files of finished jobs only when the driver collects garbage, which it is asked to do here."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once all that is derived from them is written itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread_out(df: DataFrame, store: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """A stored copy in at least two parts per core, for rows that cost far more to work on than to read."""
    stored = store(df)
    wanted = 2 * stored.sparkSession.sparkContext.defaultParallelism
    parts = len(stored.inputFiles()) if store is written else stored.rdd.getNumPartitions()
    if parts >= wanted:
        return stored
    spread = store(stored.repartition(wanted))
    if store is written:
        discard(stored)
    return spread
