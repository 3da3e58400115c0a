"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids and the like up to which one side of a join is broadcast instead of shuffling texts.
BROADCAST_ROWS = 2_000_000
#: Bytes of an Arrow batch of texts or sets. Spark's own 64 MB are held once in the JVM and several times in Python by every task.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on the session's Arrow batches hold size bytes at most, or what the session has set if that is less.

    The setting is read when a plan is made, so it cannot be put back here.
    """
    if int(spark.conf.get(_SETTING).rstrip("bB")) > size:
        spark.conf.set(_SETTING, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(staged_table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has limit rows at most; with more, the join shuffles both sides."""
    return F.broadcast(staged_table) if staged_table.count() <= limit else staged_table
