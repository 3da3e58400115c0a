"""Connected regions of rasters: labels, measures, adjacency, cleanup, confidence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.scalars import consistency_score, point_score, size_score
from pointweave.operators import image_runs
from pointweave.operators.graph import connected_components
from pointweave.operators.image_runs import least_reached  # noqa: F401
from pointweave.operators.runs import closed_runs, decode_runs, encode_runs, filled_by, in_tasks, merged_runs, of_both, own_sides, side, small_and_large
from pointweave.plans.scratch import staged


#: Rows of an image whose runs one task labels.
BLOCK_ROWS = 256
REGION = ["image_id", "region_id"]


def _blocks_labelled(slack: int):
    def label(table: pa.Table) -> pa.Table:
        """The runs of a block of rows with the id of the first run that they hang together with inside it."""
        return table.append_column("region_id", pa.array(image_runs.labelled(image_runs.runs_of(table), slack)))

    return label


def labelled_runs(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """Runs (image_id, class_id, y, x0, x1) plus region_id, a number of the region's own in its image, in the order of first pixels.

    Regions are of one class, 8- or 4-connected. Runs are labelled inside blocks of rows, each in one task; only
    blocks of one image that meet at a border are then joined, by their border rows. Ids go with image_id, which may be any number.
    The result is written, so it need not be staged; a copy of it would have as few files as tasks that read it.
    """
    slack = {8: 1, 4: 0}[connectivity]
    own = runs.select("image_id", "class_id", "y", "x0", "x1")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    blocks = own.groupBy("image_id", F.floor(F.col("y") / BLOCK_ROWS)).applyInArrow(_blocks_labelled(slack), f"{schema}, region_id long")
    blocks = staged(blocks, "blocks")
    upper = blocks.filter(F.col("y") % BLOCK_ROWS == BLOCK_ROWS - 1)
    lower = blocks.filter((F.col("y") % BLOCK_ROWS == 0) & (F.col("y") > 0)).select("image_id", "class_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("region_id").alias("_region"))
    met = upper.join(lower, ["image_id", "class_id", "y"]).filter((F.col("_x0") <= F.col("x1") + slack) & (F.col("_x1") >= F.col("x0") - slack))
    edges = staged(met.select("image_id", F.col("region_id").alias("a"), F.col("_region").alias("b")).distinct(), "borders")
    if edges.limit(1).count() == 0:
        return blocks
    name = lambda c: F.struct("image_id", F.col(c).alias("region_id"))
    joined = staged(connected_components(edges.select(name("a").alias("a"), name("b").alias("b"))), "joined")
    moved = joined.select("id.image_id", "id.region_id", F.col("component.region_id").alias("_first"))
    return staged(blocks.join(moved, REGION, "left").withColumn("region_id", F.coalesce("_first", "region_id")).select(blocks.columns), "labelled")


def region_measures(labelled: DataFrame) -> DataFrame:
    """(image_id, class_id, region_id, area, bbox_x, bbox_y, bbox_w, bbox_h, centre_y, centre_x); centres truncated."""
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    area = F.sum(n)
    return labelled.groupBy("image_id", "class_id", "region_id").agg(
        area.alias("area"),
        F.min("x0").alias("bbox_x"),
        F.min("y").alias("bbox_y"),
        (F.max("x1") - F.min("x0") + 1).alias("bbox_w"),
        (F.max("y") - F.min("y") + 1).alias("bbox_h"),
        (F.sum(n * F.col("y")) / area).cast("int").alias("centre_y"),
        (F.sum(n * (F.col("x0") + F.col("x1"))) / (2 * area)).cast("int").alias("centre_x"),
    )


def region_colours(labelled: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, b, g, r): mean channels over the region's pixels.

    Runs are shuffled by image, as pixels are where they were dealt so, and only then taken apart.
    """
    inside = labelled.repartition("image_id").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "region_id").join(pixels, ["image_id", "y", "x"])
    return inside.groupBy("image_id", "region_id").agg(*[F.avg(c).alias(c) for c in "bgr"])


def region_adjacency(labelled: DataFrame, gap: int = 1, same_class: bool = False) -> DataFrame:
    """(image_id, lo, hi): different regions that touch side by side or one above the other, or lie up to gap pixels apart there."""
    other = labelled.select("image_id", F.col("class_id").alias("_class"), F.col("y").alias("_y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("region_id").alias("_region"))
    fits = (F.col("region_id") != F.col("_region")) & (F.col("class_id") == F.col("_class") if same_class else F.lit(True))
    if gap == 1:  # only a row's next run can begin beside one
        row = W.partitionBy("image_id", "y").orderBy("x0")
        nexts = labelled.withColumns({f"_{n}": F.lead(c).over(row) for n, c in (("x0", "x0"), ("class", "class_id"), ("region", "region_id"))})
        beside = nexts.filter(fits & (F.col("_x0") == F.col("x1") + 1))
    else:
        beside = labelled.join(other.withColumnRenamed("_y", "y"), ["image_id", "y"]).filter(fits & (F.col("_x0") > F.col("x1")) & (F.col("_x0") <= F.col("x1") + gap))
    steps = F.explode(F.sequence(F.lit(1), F.lit(gap)))
    down = other.withColumn("_d", steps).withColumn("y", F.col("_y") - F.col("_d")).drop("_y", "_d")
    above = labelled.join(down, ["image_id", "y"]).filter(fits & (F.col("_x0") <= F.col("x1")) & (F.col("_x1") >= F.col("x0")))
    pair = ["image_id", F.least("region_id", "_region").alias("lo"), F.greatest("region_id", "_region").alias("hi")]
    return beside.select(*pair).union(above.select(*pair)).distinct()


def segment_counts(labelled: DataFrame) -> DataFrame:
    """(image_id, class_id, regions): regions by class, and over all classes where class_id is null."""
    return labelled.rollup("image_id", "class_id").agg(F.count_distinct("region_id").alias("regions")).filter("image_id is not null")


def without_speckles(raster_runs: DataFrame, least_area: int = 100) -> DataFrame:
    """Labelled runs (8-connected) of the regions with at least this area."""
    labelled = labelled_runs(raster_runs, 8)
    return labelled.join(region_measures(labelled).filter(F.col("area") >= least_area).select(REGION), REGION, "left_semi").select(labelled.columns)


#: Side of the tiles that the nearest pixels of bridges are looked for in.
TILE = 64


def _chamfer(dx, dy):
    return F.lit(0.955) * F.abs(dx - dy) + F.lit(1.3693) * F.least(dx, dy)


def bridge_targets(labelled: DataFrame, threshold: int) -> DataFrame:
    """(image_id, class_id, region_id, from_y, from_x, to_y, to_x): for every region below the threshold, from its
    truncated centre, the pixel of its class's regions at or above it that is nearest by L1, first by row and column.

    Pixels within the window of the chamfer distance plus five are looked at. Classes without both kinds of regions
    give none. A region meets the tiles of its class in its image, by their extents, and then only the runs of those
    that can hold its nearest pixel or reach into its window.
    """
    measured = staged(region_measures(labelled), "measures")
    small = measured.filter(F.col("area") < threshold).select("image_id", "class_id", "region_id", F.col("centre_y").alias("from_y"), F.col("centre_x").alias("from_x"))
    large = labelled.join(measured.filter(F.col("area") >= threshold).select(REGION), REGION, "left_semi")
    cut = large.withColumn("_ty", F.floor(F.col("y") / TILE)).withColumn("_tx", F.explode(F.sequence(F.floor(F.col("x0") / TILE), F.floor(F.col("x1") / TILE))))
    tile = ["image_id", "class_id", "_ty", "_tx"]
    ends = F.greatest("x0", F.col("_tx") * TILE).cast("int").alias("x0"), F.least("x1", F.col("_tx") * TILE + TILE - 1).cast("int").alias("x1")
    cut = staged(cut.select(*tile, "y", *ends), "cut")
    extents = cut.groupBy(*tile).agg(F.min("y").alias("_top"), F.max("y").alias("_bottom"), F.min("x0").alias("_left"), F.max("x1").alias("_right"))

    def least(low, high, at):
        return F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0))

    def most(low, high, at):
        return F.greatest(F.abs(F.col(low) - F.col(at)), F.abs(F.col(high) - F.col(at)))

    met = small.join(extents, ["image_id", "class_id"])
    dx, dy = least("_left", "_right", "from_x"), least("_top", "_bottom", "from_y")
    met = met.withColumns({"_dx": dx, "_dy": dy, "_far": _chamfer(most("_left", "_right", "from_x"), most("_top", "_bottom", "from_y"))})
    by_region = W.partitionBy(REGION)
    bound = F.min("_far").over(by_region)  # no nearest pixel is farther
    met = met.withColumn("_bound", bound).filter((_chamfer(F.col("_dx"), F.col("_dy")) <= F.col("_bound")) | (F.greatest("_dx", "_dy") <= F.floor("_bound") + 6))
    near = F.greatest("x0", F.least("x1", "from_x"))
    pairs = met.select(*tile, "region_id", "from_y", "from_x").join(cut, tile).withColumns({"to_x": near, "_dx": F.abs(near - F.col("from_x")), "_dy": F.abs(F.col("y") - F.col("from_y"))})
    reach = F.floor(F.min(_chamfer(F.col("_dx"), F.col("_dy"))).over(by_region)) + 5
    inside = pairs.withColumn("_reach", reach).filter((F.col("_dx") <= F.col("_reach")) & (F.col("_dy") <= F.col("_reach")))
    best = F.min(F.struct((F.col("_dx") + F.col("_dy")).alias("l1"), F.col("y").alias("to_y"), "to_x")).alias("best")
    return inside.groupBy(*REGION, "class_id", "from_y", "from_x").agg(best).select("image_id", "class_id", "region_id", "from_y", "from_x", "best.to_y", "best.to_x")


def bridged_runs(runs: DataFrame, targets: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Runs of the raster with a line two pixels wide from each region to its target, on background only, lowest class first.

    Sides are numbers, or columns of the runs where images differ; those stay in the result.
    """
    sizes = own_sides(width, height)
    if sizes:
        targets = targets.join(runs.select("image_id", *sizes).distinct(), "image_id")
    steps = F.greatest(F.abs(F.col("to_y") - F.col("from_y")), F.abs(F.col("to_x") - F.col("from_x")))
    line = targets.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    along = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("_i") / F.greatest("_n", F.lit(1))).cast("int")
    centre = line.select("image_id", "class_id", *sizes, along("from_y", "to_y").alias("_y"), along("from_x", "to_x").alias("x0"))
    drawn = centre.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1)))).select("image_id", "class_id", *sizes, (F.col("_y") + F.col("_d")).alias("y"), "x0", F.least(F.col("x0") + 1, side(width) - 1).alias("x1"))
    drawn = drawn.filter(F.col("y").between(0, side(height) - 1) & F.col("x0").between(0, side(width) - 1))
    return filled_by(runs, merged_runs(drawn, ["image_id", "class_id", *sizes, "y"]), sizes)


def bridged_regions(runs: DataFrame, threshold: int, width: int | str, height: int | str) -> DataFrame:
    """bridged_runs from the 8-connected regions below the threshold to their bridge_targets.

    An image within image_runs.SIDE goes through all of it in its task, larger ones over tables."""
    small, large = small_and_large(runs, width, height)
    if small is not None:
        small = in_tasks(small, width, height, lambda own, w, h, _: image_runs.bridged(own, image_runs.labelled(own, 1), threshold, w, h))
    if large is not None:
        large = bridged_runs(large, bridge_targets(labelled_runs(large, 8), threshold), width, height)
    return of_both(small, large)


def bridged(raster: DataFrame, targets: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """bridged_runs by pixel."""
    sizes = own_sides(width, height)
    runs = staged(encode_runs(raster, ("image_id", "class_id", *sizes)), "runs")
    return decode_runs(bridged_runs(runs, targets, width, height), tuple(sizes))


def colour_groups(labelled: DataFrame, colours: DataFrame, distance: float, gap: int = 1) -> DataFrame:
    """(image_id, region_id, group_id) of regions joined to like-coloured neighbours of their class.

    Regions of one class that touch are one region already, so a gap of one joins nothing; a wider gap joins regions
    that lie that near.
    """
    pairs = region_adjacency(labelled, gap, same_class=True)
    end = lambda name, p: colours.select("image_id", F.col("region_id").alias(name), *[F.col(c).alias(p + c) for c in "bgr"])
    far = F.sqrt(sum((F.col("lo_" + c) - F.col("hi_" + c)) ** 2 for c in "bgr"))
    close = pairs.join(end("lo", "lo_"), ["image_id", "lo"]).join(end("hi", "hi_"), ["image_id", "hi"]).filter(far < distance)
    name = lambda c: F.struct("image_id", F.col(c).alias("region_id"))
    grouped = connected_components(close.select(name("lo").alias("a"), name("hi").alias("b")))
    grouped = grouped.select("id.image_id", "id.region_id", F.col("component.region_id").alias("_group"))
    ids = labelled.select(REGION).distinct()
    return ids.join(grouped, REGION, "left").select(*REGION, F.coalesce("_group", "region_id").alias("group_id"))


#: Kernel that closes the gaps between like-coloured regions.
COLOUR_KERNEL = 7


def colour_merged_runs(runs: DataFrame, pixels: DataFrame, distance: float, width: int | str, height: int | str, gap: int = 1, kernel: int = COLOUR_KERNEL) -> DataFrame:
    """Runs of the raster with the background between the regions of a colour group closed by an elliptical kernel, lowest class first.

    Only groups of several regions are closed, each by itself; so with a gap of one nothing changes. Sides are numbers,
    or columns of the runs where images differ; those stay in the result.
    """
    sizes = own_sides(width, height)
    labelled = labelled_runs(runs, 8)
    groups = staged(colour_groups(labelled, region_colours(labelled, pixels), distance, gap), "groups")
    several = groups.groupBy("image_id", "group_id").count().filter("count > 1").select("image_id", "group_id")
    held = labelled.join(groups.join(several, ["image_id", "group_id"]), REGION).select("image_id", "class_id", "group_id", "y", "x0", "x1")
    if sizes:
        held = held.join(runs.select("image_id", *sizes).distinct(), "image_id")
    closed = closed_runs(staged(held, "held"), kernel, width, height, ["image_id", "class_id", "group_id", "y"])
    return filled_by(runs, closed, sizes)


def colour_merged(raster: DataFrame, pixels: DataFrame, distance: float, width: int | str, height: int | str, gap: int = 1, kernel: int = COLOUR_KERNEL) -> DataFrame:
    """colour_merged_runs by pixel."""
    sizes = own_sides(width, height)
    runs = staged(encode_runs(raster, ("image_id", "class_id", *sizes)), "runs")
    return decode_runs(colour_merged_runs(runs, pixels, distance, width, height, gap, kernel), tuple(sizes))


def region_confidence(raster_runs: DataFrame, points: DataFrame, labelset_lookup: DataFrame, pixels_per_image: int | DataFrame) -> DataFrame:
    """labelled_confidence of the 4-connected regions of a raster."""
    return labelled_confidence(labelled_runs(raster_runs, 4), points, labelset_lookup, pixels_per_image)


def known_points(points: DataFrame, labelset_lookup: DataFrame) -> DataFrame:
    """(image_id, y, x, _point_class) of points, the class being null for unknown labels; the lookup is of at most 255 rows."""
    known = points.join(F.broadcast(labelset_lookup.select("label", F.col("class_id").alias("_point_class"))), "label", "left")
    return known.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "_point_class")


def labelled_confidence(labelled: DataFrame, points: DataFrame, labelset_lookup: DataFrame, pixels_per_image: int | DataFrame) -> DataFrame:
    """Confidence 0..100 of every region of labelled runs, from the points in it, their agreement and its size.

    points are in bounds, known label or not; labelset_lookup is (label, class_id), of at most 255 rows;
    pixels_per_image is a number, or a table (image_id, pixels) of images of different sizes.
    """
    measured = region_measures(labelled).select("image_id", "class_id", "region_id", F.col("area").alias("size"))
    inside = known_points(points, labelset_lookup).withColumnRenamed("x", "_x").join(labelled, ["image_id", "y"]).filter("_x between x0 and x1")
    counted = inside.groupBy(REGION).agg(F.count("*").alias("points_in_region"), F.sum(F.when(F.col("_point_class") == F.col("class_id"), 1).otherwise(0)).alias("matching_points"))
    n, m = F.coalesce("points_in_region", F.lit(0)), F.coalesce("matching_points", F.lit(0))
    if isinstance(pixels_per_image, DataFrame):
        measured, pixels_per_image = measured.join(pixels_per_image.select("image_id", F.col("pixels").alias("_pixels")), "image_id"), F.col("_pixels")
    rows = measured.join(counted, REGION, "left").select("image_id", "class_id", "region_id", "size", (F.col("size") / pixels_per_image).alias("size_ratio"), n.alias("points_in_region"), m.alias("matching_points"))
    return scored_regions(rows)


def scored_regions(rows: DataFrame) -> DataFrame:
    """rows (size_ratio, points_in_region, matching_points) with their scores and their sum, the confidence."""
    n, m = F.col("points_in_region"), F.col("matching_points")
    scored = rows.withColumns({"point_score": point_score(n), "consistency_score": consistency_score(n, m), "size_score": size_score(F.col("size_ratio"))})
    return scored.withColumn("confidence", F.col("point_score") + F.col("consistency_score") + F.col("size_score"))


def confidence_summary(regions: DataFrame) -> DataFrame:
    """One row: least, greatest and mean confidence and the number of regions; zeros without any."""
    return regions.agg(*[F.coalesce(f("confidence"), F.lit(0.0)).alias(name) for f, name in ((F.min, "least"), (F.max, "greatest"), (F.avg, "mean"))], F.count("*").alias("regions"))


def confident_runs(labelled: DataFrame, regions: DataFrame, threshold: float) -> DataFrame:
    """Labelled runs of the regions with at least the confidence."""
    return labelled.join(regions.filter(F.col("confidence") >= threshold).select(REGION), REGION, "left_semi")


def confident_raster(labelled: DataFrame, regions: DataFrame, threshold: float) -> DataFrame:
    """Pixels of the regions with at least the confidence."""
    return decode_runs(confident_runs(labelled, regions, threshold))
