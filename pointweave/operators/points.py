"""Point annotations: bounds, labels, quality of an image's points, label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.scalars import scaled_round_value, snapped


def in_bounds(points: DataFrame, width: int | str = "width", height: int | str = "height") -> DataFrame:
    """Points whose truncated y, x lie in the image; points with a null coordinate lie nowhere."""
    w, h = (F.col(v) if isinstance(v, str) else F.lit(v) for v in (width, height))
    y, x = F.col("y").cast("int"), F.col("x").cast("int")
    return points.filter((y >= 0) & (y < h) & (x >= 0) & (x < w))


def class_lookup(labelset: DataFrame) -> DataFrame:
    """(label, class_id): of several entries with one short code the last counts, by seq, or by class id where the label
    set has no seq; ids must be 1..255."""
    order = "seq" if "seq" in labelset.columns else "class_id"
    return labelset.filter(F.col("class_id").between(1, 255)).groupBy(F.col("short_code").alias("label")).agg(F.max_by("class_id", order).alias("class_id"))


def labelled(points: DataFrame, labelset: DataFrame) -> DataFrame:
    """Points with a known label, plus class_id. A label set has at most 255 classes."""
    return points.join(F.broadcast(class_lookup(labelset)), "label")


def enriched_labels(labelset: DataFrame, meta: DataFrame) -> DataFrame:
    """Label rows with name and group from the metadata, else their own, else the short code and Unknown."""
    found = meta.select("short_code", F.col("name").alias("_name"), F.col("functional_group").alias("_group"))
    return (
        labelset.join(found, "short_code", "left")
        .withColumn("name", F.coalesce("_name", "name", "short_code"))
        .withColumn("functional_group", F.coalesce("_group", "functional_group", F.lit("Unknown")))
        .drop("_name", "_group")
    )


def quality_reasons(points: DataFrame, least_points: int = 90, cells: int = 8) -> DataFrame:
    """(image_id, points, cells, reason): 'low count' below least_points, 'poor spread' if fewer than cells of the 2 x 4
    cells of the points' own bounding box hold a point, else 'kept'. A box counts one more than the difference of its
    ends, so cells of whole-number places are alike. Points with a null coordinate do not count."""
    sound = points.dropna(subset=["row", "col"])
    box = sound.groupBy("image_id").agg(F.count("*").alias("points"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))

    def cell(value: str, low: str, high: str, parts: int):
        step = (F.col(high) - F.col(low) + 1) / parts
        return F.least(((F.col(value) - F.col(low)) / step).cast("int"), F.lit(parts - 1))

    hit = sound.select("image_id", "row", "col").distinct().join(box, "image_id")
    hit = hit.groupBy("image_id").agg(F.count_distinct(cell("row", "r0", "r1", 2) * 4 + cell("col", "c0", "c1", 4)).alias("cells"))
    reason = F.when(F.col("points") < least_points, "low count").when(F.col("cells") < cells, "poor spread").otherwise("kept")
    return box.join(hit, "image_id").select("image_id", "points", "cells", reason.alias("reason"))


def round_parameters(images: DataFrame, rounds: DataFrame, options: DataFrame) -> DataFrame:
    """(image_id, round, kind, value): every round's value scaled to the image and snapped to its kind's options.

    rounds (round, kind, value) and options (kind, options array) are small tables of settings.
    """
    table = rounds.join(options, "kind")
    value = snapped(scaled_round_value(F.col("kind"), F.col("value"), F.col("scale")), F.col("options"))
    return images.crossJoin(F.broadcast(table)).select("image_id", "round", "kind", value.alias("value"))  # a few rounds an image
