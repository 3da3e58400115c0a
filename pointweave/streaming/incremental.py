"""Incremental export: images that arrive as files are processed once, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.names import not_yet_exported, numbered
from pointweave.sources.files import IMAGE_SUFFIXES


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else None


def export_new_images(
    spark: SparkSession,
    source: DataFrame,
    target: str,
    checkpoint: str,
    annotate: Callable[[DataFrame], DataFrame],
):
    """Start a query that takes all images now in a stream (image_name, ...), batch by batch, and stops.

    annotate(images) gives annotation rows (image_name, ...) without ids. Every batch drops images that are
    exported already, numbers the rest after the greatest id so far, and writes annotations before images, each
    under the batch's own folder, which a retried batch overwrites. An image counts as exported once its row is
    there, so one that failed is taken again in a later run.
    """

    def batch(images: DataFrame, number: int) -> None:
        done = _existing(spark, f"{target}/images")
        names = images.dropDuplicates(["image_name"])
        start, marks = 0, 0
        if done is not None:
            earlier = done.filter(F.col("batch") != number)
            names = not_yet_exported(names, earlier)
            start = earlier.agg(F.max("id")).first()[0] or 0
        written = _existing(spark, f"{target}/annotations")
        if written is not None:
            marks = written.filter(F.col("batch") != number).agg(F.max("id")).first()[0] or 0
        fresh = _numbered(names, ["image_name"], start)
        made = annotate(fresh).join(fresh.select("image_name", F.col("id").alias("image_id")), "image_name").drop("image_name")
        rows = _numbered(made, ["image_id", *[c for c in made.columns if c != "image_id"]], marks)
        rows.write.mode("overwrite").parquet(f"{target}/annotations/batch={number}")
        fresh.select("id", F.col("image_name").alias("file_name")).write.mode("overwrite").parquet(f"{target}/images/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbered(df: DataFrame, order: list[str], after: int) -> DataFrame:
    """Ids of a batch of any size."""
    return numbered(df, order, "id", after)


def image_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New image files of a folder as (image_name, path)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    files = files.select("path").filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES))  # in letters of either case
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("image_name"), "path")
