"""Annotation documents in COCO form: tables, outer polygons, the JSON file and its continuation."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.names import numbered
from pointweave.operators.regions import region_measures
from pointweave.plans.scratch import staged

#: Regions with fewer pixels are not exported.
LEAST_AREA = 10

#: Neighbours of a pixel clockwise from the one to its right, rows counted downwards.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


class RunSet:
    """The pixels of a region as runs by row: memory grows with runs, whatever their length."""

    def __init__(self, y, x0, x1):
        self.rows: dict[int, tuple[list[int], list[int]]] = {}
        for row, a, b in sorted(zip(y, x0, x1)):
            begins, ends = self.rows.setdefault(row, ([], []))
            begins.append(a)
            ends.append(b)

    def __contains__(self, place: tuple[int, int]) -> bool:
        row = self.rows.get(place[0])
        if row is None:
            return False
        at = bisect_right(row[0], place[1]) - 1
        return at >= 0 and place[1] <= row[1][at]

    def first(self) -> tuple[int, int]:
        y = min(self.rows)
        return y, self.rows[y][0][0]


def outer_boundary(pixels: set[tuple[int, int]] | RunSet) -> list[tuple[int, int]]:
    """Corner pixels (x, y) of the outer border of an 8-connected set, straight stretches without their inner pixels.

    The border is followed clockwise from the first pixel by row and column until it would repeat its first step.
    """
    start = pixels.first() if isinstance(pixels, RunSet) else min(pixels)
    corners, at, came, first, before = [], start, 4, None, None
    while True:
        for turn in range(1, 9):
            direction = (came + turn) % 8
            step = (at[0] + _AROUND[direction][0], at[1] + _AROUND[direction][1])
            if step in pixels:
                break
        else:
            return [(start[1], start[0])]
        if (at, direction) == first:
            break
        if first is None:
            first = (at, direction)
        elif direction != before:
            corners.append((at[1], at[0]))
        at, came, before = step, (direction + 4) % 8, direction
    return [(start[1], start[0]), *corners] if before != first[1] else corners


#: Rows of an image of which one task follows the borders of the regions that begin there.
BAND_ROWS = 64


def boundary_polygons(labelled: DataFrame) -> DataFrame:
    """(image_id, class_id, region_id, polygon array<int> of x, y, ...) of every region's outer border; holes are ignored.

    One group is the regions of an image that begin in a band of its rows. Borders are followed on runs, so a region
    that fills an image is a run a row.
    """

    def trace(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("region_id", "class_id", "y", "x0", "x1")}
        order = np.argsort(columns["region_id"], kind="stable")
        cuts = np.flatnonzero(np.diff(columns["region_id"][order])) + 1
        regions, classes, polygons = [], [], []
        for rows in np.split(order, cuts):
            held = RunSet(*(columns[c][rows].tolist() for c in ("y", "x0", "x1")))
            regions.append(int(columns["region_id"][rows[0]]))
            classes.append(int(columns["class_id"][rows[0]]))
            polygons.append([v for p in outer_boundary(held) for v in p])
        return pa.table({"image_id": pa.array([table.column("image_id")[0].as_py()] * len(regions), pa.int64()), "class_id": pa.array(classes, pa.int32()), "region_id": pa.array(regions, pa.int64()), "polygon": pa.array(polygons, pa.list_(pa.int32()))})

    rows = labelled.select(F.col("image_id").cast("long").alias("image_id"), F.col("class_id").cast("int").alias("class_id"), "region_id", "y", "x0", "x1")
    band = F.shiftright("region_id", 32) / BAND_ROWS  # a region's number begins with its first row
    return rows.groupBy("image_id", F.floor(band)).applyInArrow(trace, "image_id long, class_id int, region_id long, polygon array<int>")


#: Image ids of one part of the running sum of annotation numbers.
IMAGES_A_PART = 4096


def coco_images(images: DataFrame) -> DataFrame:
    return images.select(F.col("image_id").alias("id"), F.col("image_name").alias("file_name"), "width", "height")


def coco_categories(labelset: DataFrame) -> DataFrame:
    """All entries of the label set, by class id."""
    return labelset.select(F.col("class_id").cast("int").alias("id"), F.coalesce("name", "short_code").alias("name"))


def coco_annotations(labelled: DataFrame, scale: float = 1.0, after: int = 0) -> DataFrame:
    """One annotation a region of LEAST_AREA pixels with a polygon of three corners: id, image_id, category_id,
    segmentation, bbox, area, iscrowd; coordinates are those of the image before it was scaled.

    Ids continue after the given one, by image, class and first pixel; each image's numbers are made in its own
    task and moved by the counts of the images before it.
    """
    up = 1.0 / scale
    large = region_measures(labelled).filter(F.col("area") >= LEAST_AREA)
    large = staged(large, "large")
    outlines = boundary_polygons(labelled.join(large.select("image_id", "region_id"), ["image_id", "region_id"], "left_semi")).filter(F.size("polygon") >= 6).select("image_id", "region_id", "polygon")
    kept = staged(large.join(outlines, ["image_id", "region_id"]), "annotations")
    sizes = staged(kept.groupBy("image_id").agg(F.count("*").alias("_n")).withColumn("_part", F.floor(F.col("image_id") / IMAGES_A_PART)), "sizes")
    # A running sum in two levels, so that no task orders all images.
    parts = sizes.groupBy("_part").agg(F.sum("_n").alias("_part_n"))
    parts = parts.select("_part", (F.sum("_part_n").over(W.orderBy("_part")) - F.col("_part_n")).alias("_first"))
    before = sizes.join(parts, "_part").select("image_id", (F.sum("_n").over(W.partitionBy("_part").orderBy("image_id")) - F.col("_n") + F.col("_first")).alias("_before"))
    own = F.row_number().over(W.partitionBy("image_id").orderBy("class_id", "region_id"))
    tenth = lambda c: F.bround(c * F.lit(up), 1)
    return kept.withColumn("_own", own).join(before, "image_id").select(
        (F.col("_own") + F.col("_before") + after).cast("long").alias("id"),
        "image_id",
        F.col("class_id").alias("category_id"),
        F.array(F.transform("polygon", lambda v: tenth(v.cast("double")))).alias("segmentation"),
        F.array(*[tenth(F.col(c).cast("double")) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]).alias("bbox"),
        F.bround(F.col("area") * F.lit(up * up), 1).alias("area"),
        F.lit(0).alias("iscrowd"),
    )


def next_ids(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """One row: the ids that a continued export begins after."""
    return annotations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("annotation_id")).crossJoin(images.agg(F.coalesce(F.max("id"), F.lit(0)).alias("image_id")))


def appended(existing: dict[str, DataFrame], labelled: DataFrame, images: DataFrame, scale: float = 1.0) -> dict[str, DataFrame]:
    """The tables of a document that was read, continued by the images and regions of a further run; its categories stay.

    Image and annotation ids go on after the document's greatest; images whose file name it holds already are left out
    with their regions.
    """
    new = images.join(existing["images"].select(F.col("file_name").alias("image_name")), "image_name", "left_anti")
    last = next_ids(existing["annotations"], existing["images"]).first()
    ids = staged(numbered(new.select("image_id", "image_name", "width", "height"), ["image_name"], "id", last["image_id"]), "numbered")
    own = labelled.join(ids.select("image_id", "id"), "image_id").drop("image_id").withColumnRenamed("id", "image_id")
    made = coco_annotations(staged(own, "labelled"), scale, last["annotation_id"])
    return {
        "images": existing["images"].select("id", "file_name", "width", "height").unionByName(ids.select("id", F.col("image_name").alias("file_name"), "width", "height")),
        "annotations": existing["annotations"].select(made.columns).unionByName(made),
        "categories": existing["categories"],
    }


def export_summary(wanted: DataFrame, found: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: images wanted, those matched to points, those matched by normal form only, processed, failed (matched but not exported).

    wanted (image_name), found (image_name, annotation_name), exported (file_name).
    """
    done = exported.select(F.col("file_name").alias("image_name"), F.lit(1).alias("_done")).distinct()
    rows = wanted.select("image_name").distinct().join(found.select("image_name", "annotation_name"), "image_name", "left").join(done, "image_name", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    matched = F.col("annotation_name").isNotNull()
    return rows.agg(
        F.count("*").alias("images"), count(matched).alias("matched"), count(F.coalesce(F.col("image_name") != F.col("annotation_name"), F.lit(False))).alias("by_normal_form"),
        count(matched & F.col("_done").isNotNull()).alias("processed"), count(matched & F.col("_done").isNull()).alias("failed"),
    )


def run_report(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: images, annotations, categories, and images without any annotation."""
    bare = images.join(annotations.select(F.col("image_id").alias("id")), "id", "left_anti")
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((images, "images"), (annotations, "annotations"), (categories, "categories"), (bare, "images_without_annotations"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # single rows
    return out
