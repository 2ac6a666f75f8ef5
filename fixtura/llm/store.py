"""Tables written to the shared folder, so lineage is short and a lost executor costs no recomputation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fixtura.runtime import ensure_checkpoint_dir


# Rows that go to a Python worker at once, and that a scan decodes at once. Whole texts and sets are long, and both keep the
# memory of their largest batch.
TEXT_BATCH = 500
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow and scan batches to TEXT_BATCH rows if they are larger; called by operators that read texts in Python."""
    for batch in _BATCHES:
        if not 0 < int(spark.conf.get(batch)) <= TEXT_BATCH:
            spark.conf.set(batch, str(TEXT_BATCH))


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Within the block Arrow and scan batches have at most TEXT_BATCH rows; for tables written inside it."""
    before = {batch: spark.conf.get(batch) for batch in _BATCHES}
    small_batches(spark)
    try:
        yield
    finally:
        for batch, rows in before.items():
            spark.conf.set(batch, rows)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the checkpoint folder and read back with its own schema."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` returned, once all that is derived from it is stored itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs now. It does so only when the driver collects garbage, which
    a driver that holds little may not do before the executors' disks are full."""
    spark.sparkContext._jvm.System.gc()
