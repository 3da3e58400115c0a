"""Rasters as horizontal runs: encoding, resampling, closing."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators import image_runs
from pointweave.plans.scratch import staged

#: Pixels of a row in which runs of all rounds are laid over one another at a time.
STRETCH = 128


def side(value: int | str):
    """A side of images: one number for all, or the column that holds each image's own."""
    return F.col(value) if isinstance(value, str) else F.lit(value)


def own_sides(*sides: int | str) -> list[str]:
    """The columns among sides, which the keys of a raster's rows carry along."""
    return [s for s in sides if isinstance(s, str)]


def encode_runs(raster: DataFrame, keys: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(keys..., y, x0, x1): maximal runs of equal keys in a row, ends included; (image_id, class_id) unless others are given."""
    row = W.partitionBy(*keys, "y").orderBy("x")
    island = F.col("x") - F.row_number().over(row)
    return raster.withColumn("_island", island).groupBy(*keys, "y", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")


def decode_runs(runs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "class_id", *more)


def run_sums() -> tuple:
    """(pixels, places) of runs as aggregates: how many, and the sum of 1000 y + x over them."""
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    return F.sum(n).alias("pixels"), F.sum(n * F.col("y") * 1000 + F.expr("(x0 + x1) * cast(x1 - x0 + 1 as bigint) div 2")).alias("places")


def resampled_runs(runs: DataFrame, source: tuple, target: tuple, more: tuple[str, ...] = ()) -> DataFrame:
    """Runs (image_id, class_id, y, x0, x1) of a raster of another size (width, height), without its pixels: what
    resample_nearest gives. Sides are numbers, or columns of runs; columns of more stay.

    A target pixel t shows the source at floor(t * s / d), so a run's targets reach from ceil(x0 * d / s) to
    ceil((x1 + 1) * d / s) - 1, and a row shows in as many target rows. Runs that touch afterwards become one.
    """
    (sw, sh), (dw, dh) = ((side(v).cast("long") for v in size) for size in (source, target))
    up = lambda v, s, d: F.call_function("div", v * d + s - 1, s).cast("int")
    low, high = up(F.col("y"), sh, dh), up(F.col("y") + 1, sh, dh) - 1
    placed = runs.withColumns({"x0": up(F.col("x0"), sw, dw), "x1": up(F.col("x1") + 1, sw, dw) - 1, "_low": low, "_high": high}).filter("x0 <= x1 and _low <= _high")
    rows = placed.withColumn("y", F.explode(F.sequence("_low", "_high")))
    return merged_runs(rows.select("image_id", "class_id", *more, "y", "x0", "x1"), ["image_id", "class_id", *more, "y"])


def resample_nearest(raster: DataFrame, source: tuple, target: tuple, values: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """A raster of another size (width, height): each pixel takes the one at the floor of its scaled place.

    Sides are numbers, or columns of the raster where images differ.
    """
    (sw, sh), (dw, dh) = ((side(v).cast("long") for v in size) for size in (source, target))

    def places(value: str, s, d):
        """Target places whose source is the value: ceil(value * d / s) up to the next value's."""
        low, high = (F.call_function("div", v * d + s - 1, s).cast("int") for v in (F.col(value), F.col(value) + 1))
        return F.explode(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>")))

    kept = own_sides(*source, *target)
    wide = raster.select("image_id", "y", places("x", sw, dw).alias("x"), *values, *dict.fromkeys(kept))
    return wide.select("image_id", places("y", sh, dh).alias("y"), "x", *values)


def resample_bilinear(pixels: DataFrame, source: tuple, target: tuple, values: str | list[str] = "v") -> DataFrame:
    """(image_id, y, x, values...): the weighted mean of the four pixels around each target centre, edges repeated.

    A source pixel weighs one less its distance from the target's place, which is moved into the image first. Sides
    are numbers, or columns of pixels where images differ.
    """
    values = [values] if isinstance(values, str) else values
    kept = list(dict.fromkeys(own_sides(*source, *target)))

    def along(df: DataFrame, axis: str, other: str, s, d) -> DataFrame:
        at, s, d = F.col(axis), side(s).cast("double"), side(d).cast("double")
        low = F.when(at == 0, 0).otherwise(F.ceil((at - 0.5) * d / s - 0.5))
        high = F.when(at == s - 1, d - 1).otherwise(F.floor((at + 1.5) * d / s - 0.5))
        ends = df.withColumns({"_a": F.greatest(low, F.lit(0)).cast("int"), "_b": F.least(high, d - 1).cast("int")}).filter("_a <= _b")
        spread = ends.withColumn("_t", F.explode(F.sequence("_a", "_b")))
        place = F.greatest(F.lit(0.0), F.least(s - 1, (F.col("_t") + 0.5) * s / d - 0.5))
        weight = 1 - F.abs(place - at)
        spread = spread.withColumn("_weight", weight).filter("_weight > 0")
        return spread.groupBy("image_id", other, "_t", *kept).agg(*[F.sum(F.col(v) * F.col("_weight")).alias(v) for v in values]).withColumnRenamed("_t", axis)

    (sw, sh), (dw, dh) = source, target
    return along(along(pixels.select("image_id", "y", "x", *values, *kept), "x", "y", sw, dw), "y", "x", sh, dh).select("image_id", "y", "x", *values)


def ellipse_rows(k: int) -> list[tuple[int, int, int]]:
    """(dy, first dx, last dx) of an elliptical k x k kernel around its anchor k // 2."""
    r = c = k // 2
    rows = []
    for i in range(k):
        dy = i - r
        dx = round(c * math.sqrt(max(r * r - dy * dy, 0) / (r * r))) if r else 0
        rows.append((dy, max(c - dx, 0) - c, min(c + dx, k - 1) - c))
    return rows


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a row united where they overlap or touch."""
    row = W.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1))
    new = runs.withColumn("_new", F.when(F.col("x0") <= reach + 1, 0).otherwise(1))
    groups = new.withColumn("_group", F.sum("_new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return groups.groupBy(*keys, "_group").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_group")


def dilated(runs: DataFrame, k: int, width: int | str, height: int | str, keys: list[str]) -> DataFrame:
    """Runs of all pixels p with a set pixel at p + o for some kernel offset o, inside the image."""
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in ellipse_rows(k)])
    moved = runs.withColumn("_o", F.explode(rows)).select(
        *[c for c in keys if c != "y"], (F.col("y") - F.col("_o.dy")).alias("y"), F.greatest(F.col("x0") - F.col("_o.b"), F.lit(0)).alias("x0"), F.least(F.col("x1") - F.col("_o.a"), side(width) - 1).alias("x1")
    )
    return merged_runs(moved.filter(F.col("y").between(0, side(height) - 1) & (F.col("x0") <= F.col("x1"))), keys)


def complement(runs: DataFrame, of: DataFrame, width: int | str, height: int | str, keys: list[str]) -> DataFrame:
    """What the runs leave free in every row of the images and classes that the table of has; runs are apart from one another."""
    others = [c for c in keys if c != "y"]
    frame = of.select(*others).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), side(height) - 1)))
    ends = frame.withColumn("x0", side(width)).withColumn("x1", side(width)).unionByName(runs.select(*others, "y", "x0", "x1"))
    before = F.coalesce(F.lag("x1").over(W.partitionBy(*keys).orderBy("x0")), F.lit(-1))
    return ends.select(*keys, (before + 1).alias("_a"), (F.col("x0") - 1).alias("_b")).filter("_a <= _b").select(*keys, F.col("_a").alias("x0"), F.col("_b").alias("x1"))


def closed_runs(runs: DataFrame, k: int, width: int | str, height: int | str, keys: list[str] | None = None) -> DataFrame:
    """Morphological closing of every class by an elliptical kernel; outside pixels do not erode.

    Sides are numbers, or columns of runs where images differ.
    """
    keys = [*(keys or ["image_id", "class_id", "y"]), *own_sides(width, height)]
    grown = dilated(runs, k, width, height, keys)
    cleared = dilated(complement(grown, runs, width, height, keys), k, width, height, keys)
    return complement(cleared, runs, width, height, keys)


def overlay(runs: DataFrame, *aggregates) -> DataFrame:
    """(image_id, y, x0, x1, and the aggregates): the runs of all rounds of a row cut at one another's ends, and what the
    aggregates make of those that cover each piece.

    Rows are taken in stretches, so that a run meets only the ends near it; pixels never leave their runs. Runs are
    written first, as their ends and they themselves are read.
    """
    stretch = ["image_id", "y", "_at"]
    spread = F.explode(F.sequence(F.floor(F.col("x0") / STRETCH), F.floor(F.col("x1") / STRETCH)))
    cut = staged(runs, "painted").withColumn("_at", spread)
    cut = cut.withColumns({"x0": F.greatest("x0", F.col("_at") * STRETCH).cast("int"), "x1": F.least("x1", F.col("_at") * STRETCH + STRETCH - 1).cast("int")})
    ends = cut.select(*stretch, F.explode(F.array("x0", F.col("x1") + 1)).alias("_a"))
    pieces = ends.withColumn("_b", F.lead("_a").over(W.partitionBy(*stretch).orderBy("_a")) - 1).filter("_b >= _a")
    met = pieces.join(cut, stretch).filter("_a between x0 and x1")
    return met.groupBy(*stretch, "_a", "_b").agg(*aggregates).withColumnsRenamed({"_a": "x0", "_b": "x1"}).drop("_at")


def filled_by(runs: DataFrame, cover: DataFrame, sizes: list[str] = ()) -> DataFrame:
    """Runs (image_id, class_id, sizes..., y, x0, x1) of a raster of one class a pixel, whose background takes the lowest class of
    the runs of cover there; class ids are below 65536."""
    cells = ["image_id", "class_id", *sizes, "y", "x0", "x1"]
    both = runs.select(*cells, F.lit(0).alias("_over")).unionByName(cover.select(*cells, F.lit(1).alias("_over")))
    first = F.min(F.shiftleft("_over", 16) + F.col("class_id")).bitwiseAND(F.lit((1 << 16) - 1)).cast("int").alias("class_id")
    return merged_runs(overlay(both, first, *[F.first(c).alias(c) for c in sizes]).select(cells), ["image_id", "class_id", *sizes, "y"])


def small_and_large(runs: DataFrame, width: int | str, height: int | str) -> tuple[DataFrame | None, DataFrame | None]:
    """Runs of the images that go through their steps in one task, and of the larger ones, which are written; None where there are none.

    Where sides are columns, both are written."""
    if not own_sides(width, height):
        return (runs, None) if max(width, height) <= image_runs.SIDE else (None, staged(runs, "runs"))
    runs = staged(runs, "runs")
    fits = F.coalesce(F.greatest(side(width), side(height)) <= image_runs.SIDE, F.lit(False))
    large = runs.filter(~fits)
    return runs.filter(fits), large if large.limit(1).count() else None


def in_tasks(runs: DataFrame, width: int | str, height: int | str, make, pixels: DataFrame | None = None) -> DataFrame:
    """Runs (image_id, class_id, own sides..., y, x0, x1) that make(runs, width, height, pixels) gives of each image's, which
    one task has, with its pixels (image_id, y, x, values...) if there are any. Runs dealt by image are not shuffled."""
    sizes = own_sides(width, height)
    cells = ["image_id", "class_id", *sizes, "y", "x0", "x1"]
    rows = runs.select(cells).withColumn("class_id", F.col("class_id").cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def of_image(table: pa.Table, seen: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return table
        own = (int(table.column(s)[0].as_py()) if isinstance(s, str) else s for s in (width, height))
        values = seen and tuple(seen.column(c).to_numpy() for c in seen.column_names if c != "image_id")
        return image_runs.table_of(make(image_runs.runs_of(table), *own, values), table, ["image_id", *sizes]).select(cells)

    if pixels is None:
        return rows.groupBy("image_id").applyInArrow(lambda table: of_image(table), schema)
    return rows.groupBy("image_id").cogroup(pixels.groupBy("image_id")).applyInArrow(lambda table, seen: of_image(table, seen), schema)


def of_both(small: DataFrame | None, large: DataFrame | None) -> DataFrame:
    parts = [p for p in (small, large) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def closing_runs(runs: DataFrame, k: int, width: int | str, height: int | str) -> DataFrame:
    """Runs of the raster with background that any class's closing covers filled, by the lowest such class.

    Sides are numbers, or columns of the runs where images differ; those stay in the result. An image within
    image_runs.SIDE is closed in its task, larger ones over tables.
    """
    small, large = small_and_large(runs, width, height)
    if small is not None:
        kernel = ellipse_rows(k)
        small = in_tasks(small, width, height, lambda own, w, h, _: image_runs.closing(own, kernel, w, h))
    if large is not None:
        large = filled_by(large, closed_runs(large, k, width, height), own_sides(width, height))
    return of_both(small, large)


def closing(raster: DataFrame, k: int, width: int | str, height: int | str) -> DataFrame:
    """closing_runs by pixel."""
    sizes = own_sides(width, height)
    return decode_runs(closing_runs(encode_runs(raster, ("image_id", "class_id", *sizes)), k, width, height), tuple(sizes))
