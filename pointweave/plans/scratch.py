"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys and small numbers up to which a side is broadcast.
BROADCAST_ROWS = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset (tests, one machine) a temporary one is set."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pointweave-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/pointweave-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet and read again.

    Unlike a recomputed plan it survives lost executors, cuts the lineage of loops and gives later joins
    plain exchanges on both sides, which AQE can split when a key is hot.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str = "small", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df written, and to be broadcast if it has limit rows at most; with more, a join shuffles both sides."""
    written = staged(df, name)
    return F.broadcast(written) if written.count() <= limit else written


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
