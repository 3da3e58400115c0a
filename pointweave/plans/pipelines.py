"""Labelling and export pipelines: segments by round, votes, folds, cleanup, confidence, annotation tables.

Every function takes pixel and point tables of many images, of one size or of many, and stays one plan but for the
segmenters' iterations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators import annotations, image_runs, names, points, regions, runs, votes
from pointweave.operators.runs import own_sides
from pointweave.operators.segments import adaptive_segment_runs, graph_segment_runs, superpixel_runs
from pointweave.plans.scratch import staged

#: Votes from which a segment of a later round counts as sure.
LEAST_VOTES = 3


def _round_segments(pixels: DataFrame, kind: str, value: float, width: int | str, height: int | str) -> DataFrame:
    if kind == "superpixel":
        return superpixel_runs(pixels, int(value), width, height)
    if kind == "graph":
        return graph_segment_runs(pixels, value, width, height)
    raise ValueError(f"unknown round kind: {kind}")


def segment_rounds(pixels: DataFrame, rounds: list[tuple[str, float]], width: int | str, height: int | str) -> DataFrame:
    """(image_id, round, segment_id, y, x0, x1): the segments of all rounds, in their order, as runs."""
    out = None
    for number, (kind, value) in enumerate(rounds):
        part = _round_segments(pixels, kind, value, width, height).withColumn("round", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return staged(out, "rounds")


def painted_rounds(segments: DataFrame, marks: DataFrame, labelset: DataFrame, width: int | str, height: int | str, voting: str = "majority") -> DataFrame:
    """Labelled runs of all rounds: points in bounds with known labels vote in their segments, which are runs, or pixels."""
    if "x0" not in segments.columns:
        segments = staged(votes.segment_runs(segments), "segments")
    located = votes.point_segments(points.labelled(points.in_bounds(marks, width, height), labelset), segments)
    return votes.painted(segments, votes.majority_votes(located) if voting == "majority" else votes.last_votes(located))


def label_runs(segments: DataFrame, marks: DataFrame, labelset: DataFrame, width: int | str, height: int | str, voting: str = "majority", mode: str = "fill", least_votes: int = 3) -> DataFrame:
    """Class runs (image_id, class_id, y, x0, x1): points in bounds with known labels vote in their segments, rounds fold by the mode.

    Segments are runs, or pixels. Sides are numbers, or columns of marks where images differ.
    """
    return votes.fold_runs(painted_rounds(segments, marks, labelset, width, height, voting), mode, least_votes)


def label_rounds(segments: DataFrame, marks: DataFrame, labelset: DataFrame, width: int | str, height: int | str, voting: str = "majority", mode: str = "fill", least_votes: int = 3) -> DataFrame:
    """(image_id, y, x, class_id): label_runs by pixel."""
    return runs.decode_runs(label_runs(segments, marks, labelset, width, height, voting, mode, least_votes))


def superpixel_labels(pixels, marks, labelset, width, height, counts=(3000, 900, 30)):
    return label_rounds(segment_rounds(pixels, [("superpixel", c) for c in counts], width, height), marks, labelset, width, height, "last", "fill")


def graph_labels(pixels, marks, labelset, width, height, scales=(100, 300, 1000), overwrite: bool = False, least_votes: int = 2):
    return label_rounds(segment_rounds(pixels, [("graph", s) for s in scales], width, height), marks, labelset, width, height, "majority", "confident" if overwrite else "fill", least_votes)


def hybrid_labels(pixels, marks, labelset, width, height, rounds, overwrite: bool = False):
    return label_rounds(segment_rounds(pixels, rounds, width, height), marks, labelset, width, height, "last", "overwrite" if overwrite else "fill")


def graph_first_labels(pixels, marks, labelset, width, height, discovery_scale=1000, fill_kind="superpixel", fill_values=None, overwrite: bool = False):
    fill_values = fill_values or {"superpixel": (3000, 900, 30), "graph": (100, 300, 1000)}[fill_kind]
    rounds = [("graph", discovery_scale), *((fill_kind, v) for v in fill_values)]
    return label_rounds(segment_rounds(pixels, rounds, width, height), marks, labelset, width, height, "majority", "overwrite" if overwrite else "fill")


def adaptive_labels(pixels, marks, labelset, width, height, scales=(1.0, 0.5, 0.25), min_distance=10, overwrite: bool = False, least_votes: int = 3):
    """Adaptive segments on a pyramid: pixels by bilinear, points truncated, segments back by nearest.

    All levels of all images go through one plan: an image of a level is an image with a number and sides of its own.
    """
    spark = pixels.sparkSession
    settings = spark.createDataFrame([(k, float(s), int(min_distance / s)) for k, s in enumerate(scales)], "round int, _scale double, _apart int")
    images = pixels.select("image_id", runs.side(width).alias("_full_w"), runs.side(height).alias("_full_h")).distinct().crossJoin(F.broadcast(settings))  # a few levels an image
    images = images.withColumns({"_w": (F.floor(F.col("_full_w") * F.col("_scale"))).cast("int"), "_h": F.floor(F.col("_full_h") * F.col("_scale")).cast("int")}).filter("_w > 0 and _h > 0")
    levels = staged(images.withColumn("_level", F.monotonically_increasing_id()), "levels")

    def of_levels(df: DataFrame, *columns) -> DataFrame:
        met = df.join(levels, "image_id")
        return met.select(F.col("_level").alias("image_id"), *columns, "_w", "_h", "_full_w", "_full_h", "_apart")

    wide = of_levels(pixels, "y", "x", *[F.col(c).cast("double").alias(c) for c in "bgr"])
    small = runs.resample_bilinear(wide, ("_full_w", "_full_h"), ("_w", "_h"), list("bgr"))
    numbered = levels.select(F.col("_level").alias("image_id"), "_w", "_h", "_full_w", "_full_h", "_apart", "round", F.col("image_id").alias("_image"))
    small = staged(small.join(numbered, "image_id"), "pyramid")
    moved = of_levels(marks.drop("_w", "_h", "_full_w", "_full_h"), (F.col("y") * F.col("_scale")).cast("int").alias("y"), (F.col("x") * F.col("_scale")).cast("int").alias("x"), "label", "point_seq")
    located = staged(points.labelled(points.in_bounds(moved, "_w", "_h"), labelset), "located")
    segments = staged(adaptive_segment_runs(small, located, "_w", "_h", "_apart").withColumn("round", F.lit(0)), "adaptive")
    painted = votes.painted(segments, votes.majority_votes(votes.point_segments(located, segments))).drop("round").join(numbered, "image_id")
    full = runs.resampled_runs(painted, ("_w", "_h"), ("_full_w", "_full_h"), ("round", "votes", "_image"))
    rounds = full.select(F.col("_image").alias("image_id"), "round", "class_id", "votes", "y", "x0", "x1")
    return runs.decode_runs(votes.fold_runs(rounds, "confident" if overwrite else "fill", least_votes))


def merged_runs(
    encoded: DataFrame, width: int | str, height: int | str, least_area: int = 100, small_region_merge: int = 500, kernel: int = 5, pixels: DataFrame | None = None, colour_distance: float = 0.0, gap: int = 1
) -> DataFrame:
    """Closing, then speckle removal, then bridges from small regions, from class runs to class runs; a kernel of 0 skips
    closing, and bridges are drawn only if small_region_merge exceeds least_area. With pixels and a colour distance
    above 0, gaps between like-coloured regions of a class that lie up to gap pixels apart are closed last.

    Sides are numbers, or columns of the runs where images differ; those stay in the result. An image within
    image_runs.SIDE goes through all steps in its task, larger ones over tables."""
    pixels = pixels.select("image_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in "bgr"]) if colour_distance > 0 and pixels is not None else None
    small, large = runs.small_and_large(encoded, width, height)
    if small is not None:
        own_pixels = pixels.join(small.select("image_id").distinct(), "image_id", "left_semi") if pixels is not None and own_sides(width, height) else pixels
        clean = clean_up(least_area, small_region_merge, kernel, colour_distance, gap)
        small = runs.in_tasks(small, width, height, lambda own, w, h, seen: image_runs.cleaned(own, clean, w, h, seen), own_pixels)
    if large is not None:
        large = _merged_tables(large, width, height, least_area, small_region_merge, kernel, pixels, colour_distance, gap)
    return runs.of_both(small, large).select("image_id", "class_id", "y", "x0", "x1", *own_sides(width, height))


def clean_up(least_area: int, small_region_merge: int, kernel: int, colour_distance: float = 0.0, gap: int = 1) -> image_runs.Cleanup:
    return image_runs.Cleanup(least_area, small_region_merge, runs.ellipse_rows(kernel) if kernel else None, colour_distance, gap, runs.ellipse_rows(regions.COLOUR_KERNEL))


def _merged_tables(encoded: DataFrame, width, height, least_area: int, small_region_merge: int, kernel: int, pixels: DataFrame | None, colour_distance: float, gap: int) -> DataFrame:
    """merged_runs of written runs of images of any size, step by step over tables."""
    sizes = own_sides(width, height)
    cells = ["image_id", "class_id", "y", "x0", "x1", *sizes]
    encoded = encoded.select(cells)
    of_images = staged(encoded.select("image_id", *sizes).distinct(), "sizes") if sizes else None
    if kernel:
        encoded = staged(runs.filled_by(encoded, runs.closed_runs(encoded, kernel, width, height), sizes), "closed")
    encoded = regions.without_speckles(encoded, least_area).select(cells[:5])
    if sizes:
        encoded = encoded.join(of_images, "image_id")
    if small_region_merge > least_area:
        encoded = staged(encoded, "clean")
        labelled = regions.labelled_runs(encoded, 8)
        encoded = regions.bridged_runs(encoded, regions.bridge_targets(labelled, small_region_merge), width, height)
    if pixels is not None:
        encoded = regions.colour_merged_runs(staged(encoded, "bridged"), pixels, colour_distance, width, height, gap)
    return encoded.select(cells)


#: What image_runs.measured says of a region.
_MEASURES = "class_id int, region_id long, size long, points_in_region long, matching_points long"


def _with_points(rows: DataFrame, marks: DataFrame, labelset: DataFrame):
    """Rows and known points by image, for the task that has both."""
    known = regions.known_points(marks, points.class_lookup(labelset)).fillna(-1, ["_point_class"])
    return rows.groupBy("image_id").cogroup(known.groupBy("image_id"))


def _places(marks: pa.Table) -> tuple:
    return tuple(marks.column(c).to_numpy() for c in ("y", "x", "_point_class"))


def _confident_in_tasks(painted: DataFrame, marks: DataFrame, labelset: DataFrame, mode: str, least_area: int, small_region_merge: int, kernel: int, least_confidence: float | None) -> DataFrame:
    """Class runs of images that fit a task, with sides _w, _h: labelled runs of all rounds folded, cleaned up and, if a confidence is given, without the 4-connected regions below it."""
    clean, cells = clean_up(least_area, small_region_merge, kernel), ["image_id", "class_id", "y", "x0", "x1"]
    rows = painted.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in cells[1:]], "_w", "_h", votes.fold_order(mode, LEAST_VOTES).alias("_order"))
    schema = f"image_id long, y int, x0 int, x1 int, _pixels long, {_MEASURES}"

    def of_image(table: pa.Table, marks: pa.Table) -> pa.Table:
        own, w, h = image_runs.runs_of(table), 0, 0
        if len(own.y):
            w, h = (int(table.column(c)[0].as_py()) for c in ("_w", "_h"))
            own = image_runs.cleaned(image_runs.folded(own, table.column("_order").to_numpy()), clean, w, h)
        region, found = image_runs.measured(own, 0, _places(marks))
        image = table.column("image_id")[0] if table.num_rows else pa.scalar(0, pa.int64())
        places = {c: pa.array(getattr(own, c).astype("int32")) for c in ("y", "x0", "x1")}
        return pa.table({"image_id": pa.repeat(image, len(own.y)), **places, "_pixels": pa.repeat(pa.scalar(max(w * h, 1), pa.int64()), len(own.y)), **{c: pa.array(v[region]) for c, v in found.items()}})

    made = _with_points(rows, marks, labelset).applyInArrow(lambda table, marks: of_image(table, marks), schema)
    if least_confidence is not None:
        made = regions.scored_regions(made.withColumn("size_ratio", F.col("size") / F.col("_pixels"))).filter(F.col("confidence") >= least_confidence)
    return made.select(cells)


def merged_raster(raster: DataFrame, width: int | str, height: int | str, *settings, **more) -> DataFrame:
    """merged_runs by pixel, with its settings."""
    sizes = own_sides(width, height)
    encoded = runs.encode_runs(raster, ("image_id", "class_id", *sizes))
    return runs.decode_runs(merged_runs(encoded, width, height, *settings, **more), tuple(sizes)).select("image_id", "y", "x", "class_id", *sizes)


def export(
    raster: DataFrame, images: DataFrame, labelset: DataFrame, marks: DataFrame | None = None, least_confidence: float | None = None, scale: float = 1.0, resized: bool = False
) -> dict[str, DataFrame]:
    """Annotation tables of a raster (of the scaled images), by pixel or as class runs; regions below the confidence are left out first.

    Coordinates are those of the images as they are: multiplied back, or, with resized, those of the raster that is
    brought to the images' own size before its regions are taken. Images without any labelled pixel are left out.
    """
    encoded = raster if "x0" in raster.columns else runs.encode_runs(raster)
    encoded = staged(encoded.select("image_id", "class_id", "y", "x0", "x1"), "runs")
    small = lambda c: F.floor(F.col(c) * F.lit(scale)).cast("int")
    if least_confidence is not None:
        encoded = staged(_confident(encoded, images, labelset, marks, least_confidence, scale), "runs")
    if resized:
        sizes = images.select("image_id", small("width").alias("_w"), small("height").alias("_h"), "width", "height")
        encoded = staged(runs.resampled_runs(encoded.join(sizes, "image_id"), ("_w", "_h"), ("width", "height")), "resized")
        scale = 1.0
    made = annotations.coco_annotations(regions.labelled_runs(encoded, 8), scale)
    listed = images.join(encoded.select("image_id").distinct(), "image_id", "left_semi")
    return {"images": annotations.coco_images(listed), "annotations": made, "categories": annotations.coco_categories(labelset)}


def _confident(encoded: DataFrame, images: DataFrame, labelset: DataFrame, marks: DataFrame, least_confidence: float, scale: float) -> DataFrame:
    """Written runs of the scaled images without the 4-connected regions below the confidence."""
    small = lambda c: F.floor(F.col(c) * F.lit(scale)).cast("int")
    sizes = images.select("image_id", F.greatest(small("width").cast("long") * small("height"), F.lit(1)).alias("pixels"))
    labelled = regions.labelled_runs(encoded, 4)
    scored = regions.labelled_confidence(labelled, marks, points.class_lookup(labelset), sizes)
    return regions.confident_runs(labelled, scored, least_confidence).select(encoded.columns)


def matched_points(images: DataFrame, marks: DataFrame, least_points: int = 90, exported: DataFrame | None = None) -> DataFrame:
    """Points (y, x, label, point_seq) of the images that they match by name and that pass the quality rules and are not exported yet.

    Other columns of the points are not read.
    """
    marks = marks.select("image_name", "y", "x", "label", "point_seq")
    wanted = images if exported is None else names.not_yet_exported(images, exported)
    found = names.match_batch(wanted, marks.select(F.col("image_name").alias("annotation_name")))
    rows = marks.withColumnRenamed("image_name", "annotation_name").join(found, "annotation_name").join(wanted.select("image_id", "image_name"), "image_name")
    good = points.quality_reasons(rows.select("image_id", F.col("y").cast("double").alias("row"), F.col("x").cast("double").alias("col")), least_points).filter("reason = 'kept'")
    return rows.join(good.select("image_id"), "image_id", "left_semi")


def batch_export(
    images: DataFrame, marks: DataFrame, labelset: DataFrame, segments: DataFrame | None, exported: DataFrame | None = None, least_points: int = 90, voting: str = "last", mode: str = "fill",
    least_area: int = 100, small_region_merge: int = 500, kernel: int = 5, least_confidence: float | None = None, scale: float = 1.0, resized: bool = False,
    pixels: DataFrame | None = None, rounds: list[tuple[str, float]] | None = None,
) -> dict[str, DataFrame]:
    """From images and point files to annotation tables: names are matched, images with too few or badly spread points or
    exported before go, points vote in segments, the raster is cleaned, scored and exported.

    images (image_id, image_name, width, height) may be of any number of sizes, in one plan. segments (image_id,
    round, y, x, segment_id, or as runs) are those of the images scaled by scale; without any, the images that are left are
    scaled by nearest pixels (image_id, y, x, b, g, r) and segmented by the rounds (kind, value). marks are in places of
    the images as they are. With resized, the raster is brought back to the images' size before the export. Returns
    images, annotations, categories and summary.
    """
    good = staged(matched_points(images, marks, least_points, exported), "good")
    wanted = images if exported is None else names.not_yet_exported(images, exported)
    small = lambda c: F.floor(F.col(c) * F.lit(scale)).cast("int")
    sizes = images.join(good.select("image_id").distinct(), "image_id", "left_semi")
    sizes = staged(sizes.select("image_id", F.col("width").alias("_full_w"), F.col("height").alias("_full_h"), small("width").alias("_w"), small("height").alias("_h")), "sizes")
    good = good.withColumns({c: F.bround(F.col(c) * F.lit(scale), 0).cast("int") for c in "yx"}).join(sizes, "image_id")
    if segments is None:
        own = pixels.select("image_id", "y", "x", "b", "g", "r").join(sizes, "image_id")
        scaled_pixels = runs.resample_nearest(own, ("_full_w", "_full_h"), ("_w", "_h"), ("b", "g", "r")) if scale != 1 else own
        segments = segment_rounds(staged(scaled_pixels.select("image_id", "y", "x", "b", "g", "r").join(sizes, "image_id"), "scaled"), rounds, "_w", "_h")
    else:
        segments = segments.join(sizes.select("image_id"), "image_id", "left_semi")
    painted = painted_rounds(segments, good, labelset, "_w", "_h", voting)
    fits = F.greatest("_w", "_h") <= image_runs.SIDE
    large = sizes.filter(~fits).select("image_id", "_w", "_h")
    cleaned = _confident_in_tasks(painted.join(sizes.filter(fits).select("image_id", "_w", "_h"), "image_id"), good, labelset, mode, least_area, small_region_merge, kernel, least_confidence)
    if large.limit(1).count():
        labels = votes.fold_runs(painted.join(large, "image_id", "left_semi"), mode, LEAST_VOTES).join(large, "image_id")
        rest = staged(merged_runs(labels, "_w", "_h", least_area, small_region_merge, kernel).select(cleaned.columns), "large")
        cleaned = cleaned.unionByName(rest if least_confidence is None else _confident(rest, images, labelset, good, least_confidence, scale))
    out = export(cleaned, images, labelset, scale=scale, resized=resized)
    found = names.match_batch(wanted, marks.select(F.col("image_name").alias("annotation_name")))
    return out | {"summary": annotations.export_summary(wanted, found, out["images"])}


def resized_export(images: DataFrame, marks: DataFrame, labelset: DataFrame, segments: DataFrame | None, scale: float, **settings) -> dict[str, DataFrame]:
    """The export whose raster is brought from the scaled images to their own size first, so that the least area and the
    corners of polygons are counted there; the listed sizes are those of the images as they are."""
    return batch_export(images, marks, labelset, segments, scale=scale, resized=True, **settings)


def image_report(raster: DataFrame, marks: DataFrame, labelset: DataFrame, width: int, height: int, least_area: int = 100, small_region_merge: int = 500, kernel: int = 5) -> DataFrame:
    """A row for each class of an image that the cleanup leaves, from class runs or pixels: image_id, rank, class_id, name, before, after, reduced (its
    regions), and of the image: all_before, all_after, coverage of the cleaned raster in percent, least, greatest and
    mean confidence of its regions. Classes rank by their regions after, ties by class id."""
    encoded = raster if "x0" in raster.columns else runs.encode_runs(raster)
    if max(width, height) <= image_runs.SIDE:
        measured = _report_in_tasks(encoded, marks, labelset, width, height, clean_up(least_area, small_region_merge, kernel))
    else:
        encoded = staged(encoded, "runs")
        clean = staged(merged_runs(encoded, width, height, least_area, small_region_merge, kernel), "clean")
        counts = [regions.region_measures(regions.labelled_runs(r, 8)).withColumn("size", F.col("area")).withColumns({c: F.lit(0).cast("long") for c in ("points_in_region", "matching_points")}) for r in (encoded, clean)]
        scored = regions.region_confidence(clean, marks, points.class_lookup(labelset), width * height)
        said = [part.withColumn("stage", F.lit(stage)).select(_REPORTED) for part, stage in zip((*counts, scored), _STAGES)]
        measured = said[0].unionByName(said[1]).unionByName(said[2])
    measured = staged(measured, "measured")
    of_stage = lambda stage, value: F.count(F.when(F.col("stage") == stage, value))
    by_class = measured.groupBy("image_id", "class_id").agg(*[of_stage(stage, F.lit(1)).alias(stage) for stage in _STAGES[:2]]).filter("after > 0")
    pixels = F.sum(F.when(F.col("stage") == "after", F.col("size")))
    total = measured.groupBy("image_id").agg(*[of_stage(stage, F.lit(1)).alias(f"all_{stage}") for stage in _STAGES[:2]], F.round(pixels * 100.0 / F.lit(width * height), 6).alias("coverage"))
    scored = regions.scored_regions(measured.filter(F.col("stage") == "scored").withColumn("size_ratio", F.col("size") / (width * height)))
    confidence = scored.groupBy("image_id").agg(F.min("confidence").alias("least"), F.max("confidence").alias("greatest"), F.round(F.avg("confidence"), 6).alias("mean"))
    named = by_class.join(F.broadcast(labelset.select("class_id", F.coalesce("name", "short_code").alias("name"))), "class_id")  # at most 255 classes
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("after"), "class_id"))
    rows = named.select("image_id", rank.alias("rank"), "class_id", "name", "before", "after", (F.col("before") - F.col("after")).alias("reduced"))
    for of_image in (total, confidence):
        rows = rows.join(of_image, "image_id", "left")
    return rows


#: Regions before and after the cleanup, 8-connected, and those that are scored, 4-connected.
_STAGES = ("before", "after", "scored")
_REPORTED = ["image_id", "stage", "class_id", "region_id", "size", "points_in_region", "matching_points"]


def _report_in_tasks(encoded: DataFrame, marks: DataFrame, labelset: DataFrame, width: int, height: int, clean: image_runs.Cleanup) -> DataFrame:
    """The regions of all stages of images that fit a task."""

    def of_image(table: pa.Table, marks: pa.Table) -> pa.Table:
        given, parts = image_runs.runs_of(table), []
        after = image_runs.cleaned(given, clean, width, height)
        for stage, own, slack in zip(_STAGES, (given, after, after), (1, 1, 0)):
            found = image_runs.measured(own, slack, _places(marks))[1]
            image = table.column("image_id")[0] if table.num_rows else pa.scalar(0, pa.int64())
            n = len(found["size"])
            parts.append(pa.table({"image_id": pa.repeat(image, n), "stage": pa.repeat(pa.scalar(stage), n), **{c: pa.array(v) for c, v in found.items()}}))
        return pa.concat_tables(parts)

    rows = encoded.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in ("class_id", "y", "x0", "x1")])
    return _with_points(rows, marks, labelset).applyInArrow(lambda table, marks: of_image(table, marks), f"image_id long, stage string, {_MEASURES}")
