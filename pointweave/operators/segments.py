"""Segmenters of all images at once: images that fit a tile go through their rounds in the task that has them, larger
ones through iterations over pixel and edge tables, to the same segments.

They follow published methods, not any library's bits: every pixel gets one segment, and the rules are stated here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.scalars import grey, lab
from pointweave.operators import image_runs
from pointweave.operators.filters import (
    DENSITY_SIZE, HIGH_EDGE, LOW_EDGE, Frame, density_kernel, distance_to_zero, distances_in, edge_pixels, gaussian, in_tiles, local_maxima, peaks_of, point_density, seen_through, smoothed, spaced_peaks, thin_edges,
)
from pointweave.operators.graph import connected_components
from pointweave.operators.names import numbered
from pointweave.operators.regions import labelled_runs, least_reached
from pointweave.operators.runs import encode_runs, own_sides, side
from pointweave.plans.scratch import drop_staged, staged

_AROUND4 = ((0, 1), (1, 0))
#: Side of the tiles that are flooded in one task, and of the images that are segmented in one.
TILE = 512
_RUNS = "image_id long, segment_id long, y int, x0 int, x1 int"
#: A pixel's number inside its image is its row times this, plus its column.
_ROW = 1 << 32
#: Bounds of the distance that markers keep.
LEAST_REACH, MOST_REACH = 5, 50


def with_pixel_ids(pixels: DataFrame) -> DataFrame:
    """pixels plus id, a number of their own, in the order of image, row and column: images are numbered densely, sides end at 65536."""
    images = numbered(pixels.select("image_id").distinct(), ["image_id"], "_image", -1)
    fits = F.col("y").between(0, 65535) & F.col("x").between(0, 65535)
    place = F.when(fits, F.shiftleft(F.col("y").cast("long"), 16) + F.col("x")).otherwise(F.raise_error(F.lit("sides above 65536")).cast("long"))
    return pixels.join(images, "image_id").withColumn("id", F.shiftleft("_image", 32) + place).drop("_image")


def _small_and_large(pixels: DataFrame, width: int | str, height: int | str) -> tuple[DataFrame | None, DataFrame | None]:
    """Pixels of the images that fit a tile, and of the others; None where there are none."""
    if not own_sides(width, height):
        return (pixels, None) if max(width, height) <= TILE else (None, pixels)
    fits = F.greatest(side(width), side(height)) <= TILE
    large = pixels.filter(~fits)
    return pixels.filter(fits), large if large.limit(1).count() else None


def _of_both(small: DataFrame | None, large: DataFrame | None) -> DataFrame:
    parts = [p.select("image_id", F.col("segment_id").cast("long").alias("segment_id"), "y", "x0", "x1") for p in (small, large) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_pixel(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "segment_id")


def _whole(key: tuple, table: pa.Table, reach: int, size: int, mode: str = "nearest") -> Frame:
    """An image that fits a tile."""
    return Frame((key[0], pa.scalar(0), pa.scalar(0)), table, size, (reach, reach), mode)


def _framed_images(pixels: DataFrame, width: int | str, height: int | str, values: list[str], kind: str, *more: str) -> DataFrame:
    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast(kind).alias(v) for v in values], *more, side(width).alias("_w"), side(height).alias("_h"))
    return rows.groupBy("image_id")


def _runs_of(image: int, y: np.ndarray, x: np.ndarray, segment: np.ndarray) -> pa.Table:
    """Runs of an image's pixels, which come by row and column."""
    new = np.ones(len(y), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(y))[: len(first)] - 1
    return pa.table({"image_id": pa.array(np.full(len(first), image, np.int64)), "segment_id": pa.array(segment[first].astype(np.int64)), "y": pa.array(y[first].astype(np.int32)), "x0": pa.array(x[first].astype(np.int32)), "x1": pa.array(x[last].astype(np.int32))})


def _pairs_beside(y: np.ndarray, x: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pixels, by row and column, and of those a step farther."""
    key, ends = y.astype(np.int64) * _ROW + x, []
    for step in steps if len(key) else ():
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        there = key[at] == key + step
        ends.append((np.flatnonzero(there), at[there]))
    return tuple(np.concatenate([e[i] for e in ends]) if ends else np.array([], np.int64) for i in (0, 1))


def _merged_parts(size: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, k: float, min_size: int) -> np.ndarray:
    """The part of each of an image's pixels, named by its first, after the rounds of graph_segments; a < b are ends of edges."""
    part, n, inner, small_only = np.arange(size), np.ones(size), np.zeros(size), False
    while True:
        order = np.lexsort((b, a, w))
        a, b, w = a[order], b[order], w[order]
        lightest = np.full(size, len(a))
        for ends in (a, b):
            np.minimum.at(lightest, ends, np.arange(len(a)))
        offers = np.unique(lightest[lightest < len(a)])
        x, y, weight = a[offers], b[offers], w[offers]
        joins = np.minimum(n[x], n[y]) < min_size if small_only else weight <= np.minimum(inner[x] + k / n[x], inner[y] + k / n[y])
        if not joins.any():
            if small_only:
                return part
            small_only = True
            continue
        to = least_reached(size, x[joins], y[joins])
        n = np.bincount(to, n, size)
        np.maximum.at(inner, to, inner.copy())
        np.maximum.at(inner, to[x[joins]], weight[joins])
        n[to != np.arange(size)] = 0
        part, a, b = to[part], to[a], to[b]
        apart = a != b
        a, b, w = np.minimum(a, b)[apart], np.maximum(a, b)[apart], w[apart]


def _lab_planes(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """lab() of arrays."""
    b, g, r = (np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4) for c in (b / 255.0, g / 255.0, r / 255.0))
    xyz = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.95047, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.08883
    x, y, z = (np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116) for t in xyz)
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def _nearest_centres(place: tuple, planes: list[np.ndarray], step: int, across: int, cells: int, weight: float, rounds: int) -> np.ndarray:
    """The seed cell, from 1, of each of an image's pixels after the rounds of superpixel_runs; 0 stands for none until the end."""
    y, x = place
    cell = (y // step) * across + x // step
    values, found = [*planes, y.astype(float), x.astype(float)], cell + 1
    order = np.argsort(cell, kind="stable")
    held = np.bincount(cell, minlength=cells)
    slot = np.empty(len(y), np.int64)
    slot[order] = np.arange(len(y)) - np.repeat(np.cumsum(held) - held, held)
    shape = cells, int(held.max(initial=0))
    by_cell = []  # the values of a cell's pixels, cell by cell
    for v in values:
        by_cell.append(np.zeros(shape))
        by_cell[-1][cell, slot] = v
    spare = np.empty((5, *shape))
    for _ in range(rounds):
        n = np.bincount(found, minlength=cells + 1)
        ids = np.flatnonzero(n)
        means = [np.bincount(found, v, cells + 1)[ids] / n[ids] for v in values]
        row, column = (np.floor(m / step).astype(np.int64) for m in means[3:])
        around = [(row + i, column + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        to = np.concatenate([np.where((c >= 0) & (c < across), r * across + c, -1) for r, c in around])
        centre = np.tile(np.arange(len(ids)), len(around))
        seen = (to >= 0) & (to < cells)
        first = np.lexsort((centre[seen], to[seen]))
        to, centre = to[seen][first], centre[seen][first]
        begin, count = np.searchsorted(to, np.arange(cells)), np.bincount(to, minlength=cells)
        many = np.argsort(-count, kind="stable")  # cells with most centres first, so that those with a k-th one come before the others
        begin, count, sorted_values = begin[many], count[many], [v[many] for v in by_cell]
        least, nearest = np.full(shape, np.inf), np.zeros(shape, np.int64)
        for k in range(int(count[0]) if cells else 0):  # centres of a cell in the order of their ids, so that the lower one keeps a tie
            own = int(np.searchsorted(-count, -k))
            c = centre[begin[:own] + k]
            apart = [np.subtract(v[:own], m[c][:, None], out=out[:own]) for v, m, out in zip(sorted_values, means, spare)]
            for v in apart:
                np.square(v, out=v)
            far, place = apart[0], apart[3]
            far += apart[1]
            far += apart[2]
            place += apart[4]
            place *= weight
            far += place
            np.copyto(nearest[:own], ids[c][:, None], where=far < least[:own])
            np.minimum(least[:own], far, out=least[:own])
        at = np.empty(cells, np.int64)
        at[many] = np.arange(cells)
        before, found = found, nearest[at[cell], slot]
        if (found == before).all():  # further rounds would find the same
            break
    return np.where(found > 0, found, cell + 1)


def _image_superpixels(n_segments: int, compactness: float, sigma: float, rounds: int):
    kernel, tile = gaussian(sigma), TILE

    def segmented(key: tuple, table: pa.Table) -> pa.Table:
        """Runs of the superpixels of an image that fits a tile."""
        frame = _whole(key, table, len(kernel) // 2, tile)
        seen, found = seen_through(frame, kernel, kernel, list("bgr"))
        y, x = np.nonzero(seen)
        width, height = int(table.column("_w")[0].as_py()), int(table.column("_h")[0].as_py())
        step = max(round((width * float(height) / n_segments) ** 0.5), 1)
        across = -(-width // step)
        own = _nearest_centres((y, x), _lab_planes(*[found[c][y, x] for c in "bgr"]), step, across, -(-height // step) * across, (compactness / step) ** 2, rounds)
        runs = _runs_of(frame.image, y, x, own)
        parts = image_runs.labelled(image_runs.runs_of(runs.rename_columns(["image_id", "class_id", *runs.column_names[2:]])), 0)
        return runs.set_column(1, "segment_id", pa.array(parts))

    return segmented


def superpixels(pixels: DataFrame, n_segments: int, width: int | str, height: int | str, compactness: float = 10.0, sigma: float = 1.0, rounds: int = 10) -> DataFrame:
    """superpixel_runs by pixel."""
    return _by_pixel(superpixel_runs(pixels, n_segments, width, height, compactness, sigma, rounds))


def superpixel_runs(pixels: DataFrame, n_segments: int, width: int | str, height: int | str, compactness: float = 10.0, sigma: float = 1.0, rounds: int = 10) -> DataFrame:
    """(image_id, segment_id, y, x0, x1): k-means of colour (L*a*b*) and place from a grid of seeds (Achanta et al. 2012).

    A pixel looks at the centres whose seed cell is its own or one of the eight around; ties go to the lower centre.
    Segment ids are the seed cells, from 1 by rows, and are split into their 4-connected parts afterwards. Sides are
    numbers, or columns of pixels where images differ; the seeds' distance follows each image's own. An image that fits
    a tile goes through its rounds in its task.
    """
    small, large = _small_and_large(pixels, width, height)
    if small is not None:
        small = _framed_images(small, width, height, list("bgr"), "double").applyInArrow(_image_superpixels(n_segments, compactness, sigma, rounds), _RUNS)
    if large is not None:
        large = connected_parts(_superpixel_tables(large, n_segments, width, height, compactness, sigma, rounds))
    return _of_both(small, large)


def _superpixel_tables(pixels: DataFrame, n_segments: int, width: int | str, height: int | str, compactness: float, sigma: float, rounds: int) -> DataFrame:
    """(image_id, y, x, segment_id), the seed cells of superpixel_runs for images of any size, in rounds over tables."""
    sizes = own_sides(width, height)
    colours = smoothed(pixels.select("image_id", "y", "x", *sizes, *[F.col(c).cast("double").alias(c) for c in "bgr"]), sigma, width, height, list("bgr"))
    colours = colours.withColumn("_lab", lab(F.col("b"), F.col("g"), F.col("r"))).select("image_id", "y", "x", "_lab.l", "_lab.a", F.col("_lab.b").alias("c"))
    if sizes:
        colours = colours.join(pixels.select("image_id", *sizes).distinct(), "image_id")
    seeds = F.greatest(F.bround(F.sqrt(side(width).cast("double") * side(height) / n_segments)).cast("int"), F.lit(1))
    p = colours.withColumns({"_step": seeds}).withColumn("_across", F.ceil(side(width) / F.col("_step")).cast("int"))
    p = staged(p.select("image_id", "y", "x", "l", "a", "c", "_step", "_across"), "lab")
    step, across = F.col("_step"), F.col("_across")
    cell = F.floor(F.col("y") / step) * across + F.floor(F.col("x") / step)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def means(assigned: DataFrame) -> DataFrame:
        return assigned.groupBy("image_id", "segment_id", "_step", "_across").agg(*[F.avg(v).alias("m" + v) for v in ("l", "a", "c", "y", "x")])

    assigned = p.withColumn("segment_id", (cell + 1).cast("long"))
    weight = (F.lit(compactness) / step) ** 2
    for _ in range(rounds):
        centres = staged(means(assigned), "centres")
        gy, gx = F.floor(F.col("my") / step) + F.col("_n.i"), F.floor(F.col("mx") / step) + F.col("_n.j")
        spread = centres.withColumn("_n", near).withColumn("_cell", gy * across + gx).filter((gx >= 0) & (gx < across))
        far = sum((F.col(v) - F.col("m" + v)) ** 2 for v in ("l", "a", "c")) + weight * ((F.col("y") - F.col("my")) ** 2 + (F.col("x") - F.col("mx")) ** 2)
        met = p.withColumn("_cell", cell).join(spread.drop("_step", "_across"), ["image_id", "_cell"], "left")
        assigned = met.groupBy("image_id", "y", "x").agg(F.min_by("segment_id", F.struct(far.alias("d"), "segment_id")).alias("segment_id"), *[F.first(v).alias(v) for v in ("l", "a", "c", "_step", "_across")])
    return staged(assigned.withColumn("segment_id", F.coalesce("segment_id", (cell + 1).cast("long"))).select("image_id", "y", "x", "segment_id"), "segments")


def connected_parts(segments: DataFrame) -> DataFrame:
    """Runs of segments by pixel, split into 4-connected parts, each named by its first pixel, by number inside its image."""
    runs = encode_runs(segments.select("image_id", F.col("segment_id").alias("class_id"), "y", "x"))
    return labelled_runs(runs, 4).select("image_id", "y", "x0", "x1", F.col("region_id").alias("segment_id"))


def _neighbours(pixels: DataFrame, *values: str) -> DataFrame:
    """(image_id, a, b, value_a, value_b...): pixels beside and below one another."""
    ids = pixels.select("image_id", "y", "x", F.col("id").alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    out = None
    for dy, dx in _AROUND4:
        other = pixels.select("image_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("id").alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
        pairs = ids.join(other, ["image_id", "y", "x"]).drop("y", "x")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _image_merged(scale: float, sigma: float, min_size: int):
    kernel, tile = gaussian(sigma), TILE

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        """Runs of the graph segments of an image that fits a tile."""
        frame = _whole(key, table, len(kernel) // 2, tile)
        seen, found = seen_through(frame, kernel, kernel, list("bgr"))
        y, x = np.nonzero(seen)
        a, b = _pairs_beside(y, x, (1, _ROW))
        w = np.sqrt(sum((found[c][y[a], x[a]] - found[c][y[b], x[b]]) ** 2 for c in "bgr"))
        first = _merged_parts(len(y), a, b, w, scale / 255.0, min_size)
        return _runs_of(frame.image, y, x, (y[first] << 16) + x[first])

    return merged


def graph_segments(pixels: DataFrame, scale: float, width: int | str, height: int | str, sigma: float = 0.8, min_size: int = 20) -> DataFrame:
    """graph_segment_runs by pixel."""
    return _by_pixel(graph_segment_runs(pixels, scale, width, height, sigma, min_size))


def graph_segment_runs(pixels: DataFrame, scale: float, width: int | str, height: int | str, sigma: float = 0.8, min_size: int = 20) -> DataFrame:
    """(image_id, segment_id, y, x0, x1): regions whose inner differences are small against the edge between them.

    The merge predicate of Felzenszwalb and Huttenlocher (2004) in Boruvka rounds: each component proposes its
    lightest edge (ties by ends), the edge joins if its weight is at most least(inner + scale / size) of both,
    and a component's inner difference becomes the greatest weight that joined it. When none
    joins any more, components below min_size join over their lightest edge until none is left that has one. Rounds of
    an image do not depend on other images: one that fits a tile goes through them in its task.
    """
    small, large = _small_and_large(pixels, width, height)
    if small is not None:
        channels = small.withColumns({c: F.col(c) / 255.0 for c in "bgr"})
        small = _framed_images(channels, width, height, list("bgr"), "double").applyInArrow(_image_merged(scale, sigma, min_size), _RUNS)
    if large is not None:
        large = encode_runs(_graph_tables(large, scale, width, height, sigma, min_size), ("image_id", "segment_id"))
    return _of_both(small, large)


def _graph_tables(pixels: DataFrame, scale: float, width: int | str, height: int | str, sigma: float, min_size: int) -> DataFrame:
    """(image_id, y, x, segment_id) of graph_segment_runs for images of any size, in rounds over tables."""
    values = smoothed(pixels.select("image_id", "y", "x", *own_sides(width, height), *[(F.col(c) / 255.0).alias(c) for c in "bgr"]), sigma, width, height, list("bgr"))
    values = staged(with_pixel_ids(staged(values, "smoothed")), "pixels")
    weight = F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "bgr"))
    edges = staged(_neighbours(values, *"bgr").select("a", "b", weight.alias("w")), "edges")
    parts = staged(values.select(F.col("id").alias("part"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("inner")), "parts")
    where = staged(values.select("id", F.col("id").alias("part")), "where")
    k = scale / 255.0
    small_only = False
    while True:  # each round joins two components at least
        ends = edges.select(F.col("a").alias("part"), F.struct("w", "a", "b").alias("e")).union(edges.select("b", F.struct("w", "a", "b")))
        light = ends.groupBy("part").agg(F.min("e").alias("e"))
        side = lambda name: parts.select(F.col("part").alias(name), F.col("n").alias("n_" + name), F.col("inner").alias("inner_" + name))
        offers = light.select("e.w", "e.a", "e.b").distinct().join(side("a"), "a").join(side("b"), "b")
        joins = F.col("w") <= F.least(F.col("inner_a") + k / F.col("n_a"), F.col("inner_b") + k / F.col("n_b"))
        if small_only:
            joins = F.least("n_a", "n_b") < min_size
        chosen = staged(offers.filter(joins).select("a", "b", "w"), "joins")
        if chosen.limit(1).count() == 0:
            if small_only:
                break
            small_only = True  # nothing more joins by the predicate
            continue
        merged = staged(connected_components(chosen), "merged").select(F.col("id").alias("part"), F.col("component").alias("to"))
        moved = lambda df, c: df.join(merged.withColumnRenamed("part", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        new_where = staged(moved(where, "part"), "where")
        heaviest = moved(chosen.select(F.col("a").alias("part"), "w"), "part").groupBy("part").agg(F.max("w").alias("w"))
        new_parts = moved(parts, "part").groupBy("part").agg(F.sum("n").alias("n"), F.max("inner").alias("inner"))
        new_parts = staged(new_parts.join(heaviest, "part", "left").select("part", "n", F.greatest("inner", F.coalesce("w", F.lit(0.0))).alias("inner")), "parts")
        new_edges = moved(moved(edges, "a"), "b").filter("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("w").alias("w"))
        new_edges = staged(new_edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w"), "edges")
        for old in (where, parts, edges, chosen):
            drop_staged(old)
        where, parts, edges = new_where, new_parts, new_edges
    return values.select("image_id", "y", "x", "id").join(where, "id").select("image_id", "y", "x", F.col("part").bitwiseAND(F.lit((1 << 32) - 1)).alias("segment_id"))


def _tile_flooded(table: pa.Table) -> pa.Table:
    """The own pixels of a tile with their part of the forest, as far as edges inside the tile decide it."""
    y, x, height, marker, own = (table.column(c).to_numpy() for c in ("y", "x", "height", "marker", "own"))
    key = y.astype(np.int64) * _ROW + x
    order = np.argsort(key)
    key, height, mark, own = key[order], height[order], marker[order].astype(np.int64), own[order]
    ends = []
    for step in (1, _ROW):  # beside, and below
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        there = (key[at] == key + step) & (own | own[at])
        ends.append((np.flatnonzero(there), at[there]))
    a, b = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
    rank = np.lexsort((key[b], key[a], np.maximum(height[a], height[b])))  # of no two edges alike
    a, b, part = a[rank], b[rank], np.arange(len(key))
    while True:
        a_part, b_part = part[a], part[b]
        apart = a_part != b_part
        a, b, a_part, b_part = a[apart], b[apart], a_part[apart], b_part[apart]
        lightest = np.full(len(key), len(a))
        for side in (a_part, b_part):
            np.minimum.at(lightest, side, np.arange(len(a)))
        choosing = np.flatnonzero((lightest < len(a)) & (mark == 0) & own)
        other = a_part[lightest[choosing]] + b_part[lightest[choosing]] - choosing
        choosing, other = choosing[own[other]], other[own[other]]  # an edge that leaves the tile waits
        if not len(choosing):
            break
        up = np.arange(len(key))
        up[choosing] = other
        mutual = choosing[(up[other] == choosing) & (choosing < other)]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        part = up[part]
    table = table.take(pa.array(order)).filter(pa.array(own))
    return pa.table({"image_id": table.column("image_id"), "y": table.column("y"), "x": table.column("x"), "height": table.column("height"), "part": pa.array(key[part[own]]), "marker": pa.array(mark[part[own]])})


def flooded(heights: DataFrame, markers: DataFrame) -> DataFrame:
    """(image_id, y, x, segment_id): flooding from markers, each pixel over the lowest pass; pixels meet over their four sides.

    heights: image_id, y, x, height. An edge weighs as its higher end; equal ones go by their pixels' places. The result
    is the lightest forest rooted at the markers, which a flood in order of edges makes too: a part without a marker
    joins over its lightest edge (Boruvka), so that no two markers join. Parts grow inside tiles, each in one
    task, until their lightest edge leaves the tile; the few that wait then join over tables, in rounds that grow with
    the logarithm of their number. Pixels that no marker reaches are left out.
    """
    own = markers.select("image_id", "y", "x", F.col("marker").cast("long").alias("marker"))
    seen = heights.dropna(subset=["height"]).join(own, ["image_id", "y", "x"], "left").select("image_id", "y", "x", "height", F.coalesce("marker", F.lit(0).cast("long")).alias("marker"))
    image, at = (dict(seen.dtypes)[c] for c in ("image_id", "y"))
    tiles = in_tiles(seen, TILE, 1).groupBy("image_id", "_ty", "_tx")
    local = staged(tiles.applyInArrow(_tile_flooded, f"image_id {image}, y {at}, x {at}, height double, part long, marker long"), "tiles")
    waiting = local.filter("marker = 0").select("image_id").distinct()
    some = local.join(waiting, "image_id", "left_semi").select("image_id", "y", "x", "height", "part")
    out = None
    for dy, dx in _AROUND4:
        next_ = some.select("image_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("height").alias("_h"), F.col("part").alias("b"))
        met = some.join(next_, ["image_id", "y", "x"]).filter("part <> b")
        pixel = F.col("y").cast("long") * _ROW + F.col("x")
        met = met.select("image_id", F.col("part").alias("a"), "b", F.struct(F.greatest("height", "_h").alias("w"), pixel.alias("p"), F.lit(dy).alias("d")).alias("e"))
        out = met if out is None else out.unionByName(met)
    edges = staged(out.groupBy("image_id", "a", "b").agg(F.min("e").alias("e")), "edges")
    nodes = staged(local.join(waiting, "image_id", "left_semi").select("image_id", "part", "marker").distinct(), "nodes")
    where = nodes.select("image_id", "part", F.col("part").alias("now"))
    while True:
        both = edges.select("image_id", F.col("a").alias("part"), F.col("b").alias("other"), "e").unionByName(edges.select("image_id", F.col("b").alias("part"), F.col("a").alias("other"), "e"))
        free = both.join(nodes.filter("marker = 0").select("image_id", "part"), ["image_id", "part"])
        chosen = staged(free.groupBy("image_id", "part").agg(F.min_by("other", "e").alias("other")), "chosen")
        if chosen.limit(1).count() == 0:
            break
        name = lambda c: F.struct("image_id", F.col(c).alias("part"))
        joined = connected_components(chosen.select(name("part").alias("a"), name("other").alias("b")))
        joined = staged(joined.select("id.image_id", F.col("id.part").alias("part"), F.col("component.part").alias("_to")), "joined")
        moved = lambda df, c: df.join(joined.withColumnRenamed("part", c), ["image_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        new_nodes = staged(moved(nodes, "part").groupBy("image_id", "part").agg(F.max("marker").alias("marker")), "nodes")
        new_where = staged(moved(where, "now"), "where")
        new_edges = staged(moved(moved(edges, "a"), "b").filter("a <> b").groupBy("image_id", "a", "b").agg(F.min("e").alias("e")), "edges")
        for old in (nodes, where, edges, chosen, joined):
            drop_staged(old)
        nodes, where, edges = new_nodes, new_where, new_edges
    reached = where.join(nodes.withColumnsRenamed({"part": "now", "marker": "_marker"}), ["image_id", "now"]).select("image_id", "part", "_marker")
    found = local.join(reached, ["image_id", "part"], "left").select("image_id", "y", "x", F.coalesce("_marker", "marker").alias("segment_id"))
    return found.filter("segment_id > 0")


def spaced_markers(distance: DataFrame, density: DataFrame, min_distance: int | str) -> DataFrame:
    """local_maxima of distance, spaced by each image's own min_distance * (1.5 - mean density), at least 5 and at most 50.

    min_distance is a number, or a column of density where images differ.
    """
    own = (F.max(side(min_distance)) * (1.5 - F.coalesce(F.avg("density"), F.lit(0.0)))).cast("int")
    reach = density.groupBy("image_id").agg(F.least(F.greatest(own, F.lit(LEAST_REACH)), F.lit(MOST_REACH)).alias("reach"))
    return local_maxima(distance.join(reach, "image_id"), "reach", most=MOST_REACH)


def kept_reach(apart, density):
    """The distance that markers of an image keep: that many pixels times 1.5 less its mean density, in bounds."""
    return min(max(int(apart * (1.5 - float(density.mean()))), LEAST_REACH), MOST_REACH)


def _image_flooded():
    kernel, tile = density_kernel(DENSITY_SIZE), TILE

    def segmented(key: tuple, pixels: pa.Table, points: pa.Table) -> pa.Table:
        """Runs of the adaptive segments of an image that fits a tile."""
        image, none = key[0].as_py(), np.array([], np.int64)
        if not pixels.num_rows:
            return _runs_of(image, none, none, none)
        frame = _whole(key, pixels, 2, tile)
        there = np.zeros((len(frame.rows), len(frame.columns)), bool)
        there[frame.at] = True
        y, x, slope = thin_edges(frame, "grey", LOW_EDGE)
        line = least_reached(len(y), *_pairs_beside(y, x, (1, _ROW - 1, _ROW, _ROW + 1)))
        strong = np.isin(line, line[slope >= HIGH_EDGE])
        edge, density = np.zeros(there.shape), np.zeros(there.shape)
        edge[y[strong], x[strong]] = 255.0
        if points.num_rows:
            spread = seen_through(_whole(key, points, len(kernel) // 2, tile, "reflect"), kernel, kernel, ["density"])[1]["density"]
            density = spread / spread.max() if spread.max() > 0 else density
        distance = distances_in((edge + 255 * density >= 255) & there, there)
        y, x = np.nonzero(np.isfinite(distance))
        if not len(y):
            return _runs_of(image, none, none, none)
        reach = kept_reach(pixels.column("_apart")[0].as_py(), density[there])
        rows = pa.table({"image_id": np.full(len(y), image), "y": y, "x": x, "distance": distance[y, x], "_reach": np.full(len(y), reach), "own": np.full(len(y), True)})
        peaks = peaks_of("distance")(rows)
        if not peaks.num_rows:
            return _runs_of(image, none, none, none)
        found, marker = spaced_peaks("distance")(peaks), np.zeros(there.shape, np.int64)
        marker[found.column("y").to_numpy(), found.column("x").to_numpy()] = found.column("marker").to_numpy()
        flood = _tile_flooded(rows.append_column("height", pa.array(-distance[y, x])).append_column("marker", pa.array(marker[y, x])))
        y, x, marker = (flood.column(c).to_numpy() for c in ("y", "x", "marker"))
        return _runs_of(image, y[marker > 0], x[marker > 0], marker[marker > 0])

    return segmented


def adaptive_segments(pixels: DataFrame, points: DataFrame, width: int | str, height: int | str, min_distance: int | str = 10) -> DataFrame:
    """adaptive_segment_runs by pixel."""
    return _by_pixel(adaptive_segment_runs(pixels, points, width, height, min_distance))


def adaptive_segment_runs(pixels: DataFrame, points: DataFrame, width: int | str, height: int | str, min_distance: int | str = 10) -> DataFrame:
    """(image_id, segment_id, y, x0, x1): flooding from the places farthest from edges and dense points.

    Energy is 255 on edges plus 255 times the point density, cut to 0..255; the distance is to the nearest saturated
    pixel; markers are distance maxima, spaced by min_distance * (1.5 - mean density), at least 5 and at most 50,
    by the mean of their own image. Images without a saturated pixel get no segments. Sides are numbers, or columns
    of pixels and points where images differ. An image that fits a tile is flooded in its task.
    """
    small, large = _small_and_large(pixels, width, height)
    if small is not None:
        flat = small.select("image_id", "y", "x", *own_sides(width, height), side(min_distance).alias("_apart"), grey(F.col("b"), F.col("g"), F.col("r")).alias("grey"))
        flat = _framed_images(flat, width, height, ["grey"], "double", "_apart")
        marks = _framed_images(points.withColumn("density", F.lit(1.0)), width, height, ["density"], "double")
        small = flat.cogroup(marks).applyInArrow(_image_flooded(), _RUNS)
    if large is not None:
        large = encode_runs(_adaptive_tables(large, points, width, height, min_distance), ("image_id", "segment_id"))
    return _of_both(small, large)


def _adaptive_tables(pixels: DataFrame, points: DataFrame, width: int | str, height: int | str, min_distance: int | str) -> DataFrame:
    """(image_id, y, x, segment_id) of adaptive_segment_runs for images of any size, step by step over tables."""
    points = points.filter(F.greatest(side(width), side(height)) > TILE)
    more = own_sides(min_distance)
    flat = pixels.select("image_id", "y", "x", *own_sides(width, height), *more, grey(F.col("b"), F.col("g"), F.col("r")).alias("grey"))
    edges = edge_pixels(flat, width, height).withColumn("edge", F.lit(255.0))
    density = point_density(points, width, height)
    energy = flat.join(edges, ["image_id", "y", "x"], "left").join(density, ["image_id", "y", "x"], "left")
    energy = staged(energy.select("image_id", "y", "x", *more, F.coalesce("density", F.lit(0.0)).alias("density"), (F.coalesce("edge", F.lit(0.0)) + 255 * F.coalesce("density", F.lit(0.0)) >= 255).alias("zero")), "energy")
    distance = staged(distance_to_zero(energy), "distance")
    markers = spaced_markers(distance, energy, min_distance)
    return flooded(distance.select("image_id", "y", "x", (-F.col("distance")).alias("height")), staged(markers, "markers"))
