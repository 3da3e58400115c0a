"""Image names: matching with annotations, listing, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.scalars import normalized_name
from pointweave.plans.scratch import staged


def match_batch(images: DataFrame, names: DataFrame) -> DataFrame:
    """(image_name, annotation_name) by the batch rule.

    An image finds the annotations of its own name or else of its normalised name. Annotations can be found by
    their name or, behind every exact name, by its normalised form; of several with one form the first in order
    counts. names: annotation_name, one row a name or more; null names match nothing.
    """
    keys = names.select("annotation_name").dropna().distinct()
    aliases = keys.groupBy(normalized_name("annotation_name").alias("key")).agg(F.min("annotation_name").alias("annotation_name"))
    table = keys.select(F.col("annotation_name").alias("key"), "annotation_name", F.lit(0).alias("alias")).unionByName(aliases.withColumn("alias", F.lit(1)))
    tries = images.select("image_name").dropna().distinct().select(
        "image_name", F.explode(F.array(F.struct(F.lit(0).alias("normal"), F.col("image_name").alias("key")), F.struct(F.lit(1).alias("normal"), normalized_name("image_name").alias("key")))).alias("t")
    )
    best = F.min(F.struct("normal", "alias", "annotation_name")).alias("best")
    return tries.select("image_name", "t.normal", "t.key").join(table, "key").groupBy("image_name").agg(best).select("image_name", "best.annotation_name")


def match_app(images: DataFrame, names: DataFrame) -> DataFrame:
    """(key, image_name, annotation_name): both sides normalised, the last of several names with one key counting.

    Last is by the column seq of either side, ties by name.
    """

    def last(df: DataFrame, column: str) -> DataFrame:
        return df.dropna(subset=[column]).groupBy(normalized_name(column).alias("key")).agg(F.max_by(column, F.struct("seq", column)).alias(column))

    return last(images, "image_name").join(last(names, "annotation_name"), "key")


def images_without_points(images: DataFrame, matched: DataFrame) -> DataFrame:
    return images.select("image_name").distinct().join(matched, "image_name", "left_anti")


def points_without_images(names: DataFrame, matched: DataFrame) -> DataFrame:
    return names.select("annotation_name").distinct().join(matched, "annotation_name", "left_anti")


def not_yet_exported(images: DataFrame, exported: DataFrame) -> DataFrame:
    """Images whose name is not among the file_name of an earlier export."""
    return images.join(exported.select(F.col("file_name").alias("image_name")), "image_name", "left_anti")


def resolve_paths(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(image_name, path): the file of that name, else the file whose normalised name is the normalised name; first path wins."""
    files = listing.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    table = files.select("path", F.col("file").alias("key"), F.lit(0).alias("loose")).union(files.select("path", normalized_name("file"), F.lit(1)))
    tries = names.select("image_name").distinct()
    tries = tries.select("image_name", F.col("image_name").alias("key"), F.lit(0).alias("loose")).union(tries.select("image_name", normalized_name("image_name"), F.lit(1)))
    return tries.join(table, ["key", "loose"]).groupBy("image_name").agg(F.min(F.struct("loose", "path"))["path"].alias("path"))


def search_names(names: DataFrame, text: str, column: str = "image_name") -> DataFrame:
    """Names that contain a text, whatever the case."""
    return names.filter(F.lower(column).contains(text.lower()))


def first_names(names: DataFrame, column: str = "image_name", n: int = 100) -> DataFrame:
    return names.select(column).distinct().orderBy(column).limit(n)


def top_images(points: DataFrame, n: int = 100) -> DataFrame:
    """The n images with the most annotations, ties by name."""
    return points.groupBy("image_name").agg(F.count("*").alias("points")).orderBy(F.desc("points"), "image_name").limit(n)


def normal_form_examples(found: DataFrame, n: int = 3) -> DataFrame:
    """The first n pairs (image_name, annotation_name), by image name, that only their normal form joined."""
    return found.filter("image_name <> annotation_name").select("image_name", "annotation_name").orderBy("image_name").limit(n)


def failed_examples(found: DataFrame, exported: DataFrame, n: int = 10) -> DataFrame:
    """The first n image names, in order, that match points but are in no export (file_name)."""
    done = exported.select(F.col("file_name").alias("image_name"))
    return found.select("image_name").join(done, "image_name", "left_anti").orderBy("image_name").limit(n)


def numbered(df: DataFrame, order: list[str], column: str, after: int = 0, partitions: int = 200) -> DataFrame:
    """Dense ids from after + 1 in an order, with partition-local numbers and offsets instead of one ordered task.

    Rows are ranged by the order's first column, so equal first values share a task.
    """
    ranged = df.repartitionByRange(partitions, order[0]).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(column, (own + F.col("_before") + after).cast("long")).drop("_part", "_before")
