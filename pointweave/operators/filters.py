"""Separable filters, edges, distances and maxima over pixel tables of many images at once.

Spark deals pixels to tiles, with those around that a filter sees; a task filters one tile at a time. Images may be of
any number of sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pointweave.operators.regions import labelled_runs
from pointweave.operators.runs import decode_runs, encode_runs, own_sides, side
from pointweave.plans.scratch import staged

#: Side of the tiles that one task filters or looks for maxima in.
TILE = 512
#: Side of the window that spreads points.
DENSITY_SIZE = 51
#: Gradients from which edges begin, and of which each needs one.
LOW_EDGE, HIGH_EDGE = 50, 150


def border(at: np.ndarray, size: int, mode: str) -> np.ndarray:
    """The pixels that stand for places outside: the edge one, or the mirrored one ('reflect', without the edge)."""
    if mode == "nearest" or size == 1:
        return np.clip(at, 0, size - 1)
    at = at % (2 * (size - 1))
    return np.minimum(at, 2 * (size - 1) - at)


def gaussian(sigma: float, half: int | None = None) -> list[float]:
    half = int(4 * sigma + 0.5) if half is None else half
    weights = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [w / sum(weights) for w in weights]


def in_tiles(pixels: DataFrame, size: int, around: int) -> DataFrame:
    """pixels plus _ty, _tx, the tile, and own, whether the pixel is the tile's or of those up to around pixels outside, which it sees too; places are not negative."""
    spans = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - around, F.lit(0)) / size), F.floor((F.col(c) + around) / size)))
    seen = pixels.withColumn("_ty", spans("y")).withColumn("_tx", spans("x"))
    return seen.withColumn("own", (F.floor(F.col("y") / size) == F.col("_ty")) & (F.floor(F.col("x") / size) == F.col("_tx")))


class Frame:
    """A tile of an image of its own size, with the pixels around it and those that stand for places outside the image."""

    def __init__(self, key: tuple, table: pa.Table, size: int, reach: tuple[int, int], mode: str):
        self.image, ty, tx = (k.as_py() for k in key)
        height, width = int(table.column("_h")[0].as_py()), int(table.column("_w")[0].as_py())
        self.rows, self.columns = np.arange(ty * size, min((ty + 1) * size, height)), np.arange(tx * size, min((tx + 1) * size, width))
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        self.at = y[inside], x[inside]
        self.inside, self.table = pa.array(inside), table
        self.places, self.outside = [], []
        for own, around, length in ((self.rows, reach[0], height), (self.columns, reach[1], width)):
            wide = np.arange(own[0] - around, own[-1] + around + 1) if len(own) else own
            self.places.append(border(wide, length, mode))
            self.outside.append((wide < 0) | (wide >= length))

    def grid(self, value: str | None) -> np.ndarray:
        """The column's values, 0 where no pixel is; without a column, 1 where one is."""
        low = [int(p.min()) for p in self.places]
        out = np.zeros([int(p.max()) - n + 1 for p, n in zip(self.places, low)])
        held = [(a >= n) & (a < n + size) for a, n, size in zip(self.at, low, out.shape)]
        held = held[0] & held[1]
        values = self.table.column(value).filter(self.inside).to_numpy()[held] if value else 1.0
        out[self.at[0][held] - low[0], self.at[1][held] - low[1]] = values
        return out[np.ix_(self.places[0] - low[0], self.places[1] - low[1])]


def convolved(grid: np.ndarray, across: list[float], down: list[float]) -> np.ndarray:
    """The grid filtered along rows and columns, without the margins that the kernels reach into."""
    height, width = grid.shape[0] - len(down) + 1, grid.shape[1] - len(across) + 1
    grid = sum(w * grid[:, i : i + width] for i, w in enumerate(across))
    return sum(w * grid[i : i + height] for i, w in enumerate(down))


def seen_through(frame: Frame, across: list[float], down: list[float], values: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where a tile's kernels see a pixel, and the filtered values."""
    seen = convolved(frame.grid(None), [float(w != 0) for w in across], [float(w != 0) for w in down]) > 0
    return seen, {v: convolved(frame.grid(v), across, down) for v in values}


def _framed(pixels: DataFrame, width: int | str, height: int | str, around: int):
    return in_tiles(pixels.withColumns({"_w": side(width), "_h": side(height)}), TILE, around).groupBy("image_id", "_ty", "_tx")


def separable(pixels: DataFrame, across: list[float], down: list[float], width: int | str, height: int | str, values: list[str], mode: str = "nearest") -> DataFrame:
    """(image_id, y, x, values...) filtered along rows, then along columns, wherever the kernels see a pixel; absent pixels count as 0.

    Images are filtered in tiles that see as far around as the kernels reach. Sides are numbers, or columns of
    pixels where images differ.
    """
    reach = len(down) // 2, len(across) // 2
    size = TILE

    def filtered(key: tuple, table: pa.Table) -> pa.Table:
        frame = Frame(key, table, size, reach, mode)
        if not len(frame.rows) or not len(frame.columns):
            return pa.table({n: pa.array([], k) for n, k in [("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), *[(v, pa.float64()) for v in values]]})
        seen, found = seen_through(frame, across, down, values)
        y, x = np.nonzero(seen)
        out = {"image_id": pa.array(np.full(len(y), frame.image)), "y": pa.array(frame.rows[y].astype(np.int32)), "x": pa.array(frame.columns[x].astype(np.int32))}
        return pa.table(out | {v: pa.array(found[v][y, x]) for v in values})

    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(v) for v in values], *own_sides(width, height))
    return _framed(rows, width, height, max(reach)).applyInArrow(filtered, ", ".join(["image_id long, y int, x int", *[f"{v} double" for v in values]]))


def smoothed(pixels: DataFrame, sigma: float, width: int | str, height: int | str, values: list[str]) -> DataFrame:
    kernel = gaussian(sigma)
    return separable(pixels, kernel, kernel, width, height, values)


def density_kernel(size: int) -> list[float]:
    return gaussian(0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2)


def point_density(points: DataFrame, width: int | str, height: int | str, size: int = DENSITY_SIZE) -> DataFrame:
    """(image_id, y, x, density): points in bounds, each place once, under a Gaussian window, its greatest value 1."""
    kernel = density_kernel(size)
    places = points.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *own_sides(width, height)).distinct().withColumn("density", F.lit(1.0))
    spread = staged(separable(places, kernel, kernel, width, height, ["density"], "reflect"), "density")
    top = spread.groupBy("image_id").agg(F.max("density").alias("_top"))
    return spread.join(top, "image_id").withColumn("density", F.col("density") / F.col("_top")).drop("_top")


def thin_edges(frame: Frame, value: str, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and gradients of a tile's gradient maxima of at least low; the tile sees two pixels around."""
    slope = math.tan(math.pi / 8)
    grid = frame.grid(value)
    gx, gy = convolved(grid, [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]), convolved(grid, [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0])
    m = np.abs(gx) + np.abs(gy)
    m[frame.outside[0][1:-1]] = 0
    m[:, frame.outside[1][1:-1]] = 0
    own = (slice(1, -1), slice(1, -1))
    gx, gy, middle = gx[own], gy[own], m[own]
    beside = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    flat, steep = np.abs(gy) <= slope * np.abs(gx), np.abs(gx) <= slope * np.abs(gy)
    before = np.select([flat, steep, gx * gy > 0], [beside(0, -1), beside(-1, 0), beside(-1, -1)], beside(1, -1))
    after = np.select([flat, steep, gx * gy > 0], [beside(0, 1), beside(1, 0), beside(1, 1)], beside(-1, 1))
    y, x = np.nonzero((middle >= low) & (middle > before) & (middle >= after))
    return y, x, middle[y, x]


def edge_pixels(pixels: DataFrame, width: int | str, height: int | str, low: float = LOW_EDGE, high: float = HIGH_EDGE, value: str = "grey") -> DataFrame:
    """(image_id, y, x) of thin edges: gradient maxima of at least low that hang together with one of at least high.

    Gradients and their neighbours are looked at in tiles. Sides are numbers, or columns of pixels where images differ.
    """
    size = TILE

    def thinned(key: tuple, table: pa.Table) -> pa.Table:
        frame = Frame(key, table, size, (2, 2), "nearest")
        if not len(frame.rows) or not len(frame.columns):
            return pa.table({"image_id": pa.array([], pa.int64()), "y": pa.array([], pa.int32()), "x": pa.array([], pa.int32()), "m": pa.array([], pa.float64())})
        y, x, m = thin_edges(frame, value, low)
        return pa.table({"image_id": pa.array(np.full(len(y), frame.image)), "y": pa.array(frame.rows[y].astype(np.int32)), "x": pa.array(frame.columns[x].astype(np.int32)), "m": pa.array(m)})

    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias(value), *own_sides(width, height))
    thin = _framed(rows, width, height, 2).applyInArrow(thinned, "image_id long, y int, x int, m double")
    thin = staged(thin.withColumn("class_id", F.lit(1)), "thin")
    inside = staged(labelled_runs(encode_runs(thin.select("image_id", "class_id", "y", "x")), 8), "lines")
    strong = thin.filter(F.col("m") >= high).join(inside.drop("class_id"), ["image_id", "y"]).filter("x between x0 and x1").select("image_id", "region_id").distinct()
    return decode_runs(inside.join(strong, ["image_id", "region_id"], "left_semi")).select("image_id", "y", "x")


def lower_envelope(parabolas: list[tuple[int, float]], places: list[int]) -> list[float]:
    """For each place, rising, the least (place - at) ** 2 + height over parabolas (at, height), rising too, the lower of equal at first."""
    kept, begins = [], []  # those on the envelope, and where each begins to be the least
    for at, height in parabolas:
        if kept and kept[-1][0] == at:
            continue
        begin = -math.inf
        while kept:
            before, low = kept[-1]
            begin = (height + at * at - low - before * before) / (2 * (at - before))
            if begin > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append((at, height))
        begins.append(begin)
    out, i = [], 0
    for place in places:
        while i + 1 < len(kept) and begins[i + 1] <= place:
            i += 1
        out.append((place - kept[i][0]) ** 2 + kept[i][1])
    return out


#: Pixels up to which a row's nearest zeros are looked for step by step, for all rows of a batch at once.
STEPS = 256


def _nearest_in_rows(heights: np.ndarray) -> np.ndarray:
    """Of rows of one length without gaps, for each place the least (place - at) ** 2 + height over places at of its row."""
    least = heights.copy()
    for d in range(1, min(heights.shape[1], STEPS)):
        if d * d >= least.max():
            return least
        np.minimum(least[:, d:], heights[:, :-d] + d * d, out=least[:, d:])
        np.minimum(least[:, :-d], heights[:, d:] + d * d, out=least[:, :-d])
    at = list(range(heights.shape[1]))
    for i in np.flatnonzero(least.max(axis=1) > (STEPS - 1) ** 2) if heights.shape[1] > STEPS else ():  # what lies farther
        least[i] = lower_envelope([(x, float(h)) for x, h in enumerate(heights[i]) if h < np.inf], at)
    return least


@F.pandas_udf(ArrayType(DoubleType()))
def _row_nearest(places: pd.Series, columns: pd.Series) -> pd.Series:
    """columns: distance in each pixel's column, -1 where it holds no zero."""
    out, even = [None] * len(places), {}
    for i, (xs, gs) in enumerate(zip(places, columns)):
        if int(xs[-1]) - int(xs[0]) == len(xs) - 1:
            even.setdefault(len(xs), []).append(i)
        else:
            out[i] = lower_envelope([(int(x), float(g * g)) for x, g in zip(xs, gs) if g >= 0], [int(x) for x in xs])
    for rows in even.values():
        g = np.stack([columns.iloc[i] for i in rows])
        for i, found in zip(rows, _nearest_in_rows(np.where(g >= 0, g * g, np.inf))):
            out[i] = found
    return pd.Series(out)


def distances_in(zero: np.ndarray, there: np.ndarray) -> np.ndarray:
    """distance_to_zero of an image of which all pixels that are there are at hand; infinite where there is none."""
    at = np.arange(len(zero))[:, None]
    up = np.maximum.accumulate(np.where(zero, at, -np.inf), axis=0)
    down = np.minimum.accumulate(np.where(zero, at, np.inf)[::-1], axis=0)[::-1]
    square = np.where(there, np.minimum(at - up, down - at), np.inf) ** 2
    held = np.isfinite(square).any(axis=1)
    square[held] = _nearest_in_rows(square[held]) if held.any() else square[held]
    return np.where(there, np.sqrt(square), np.inf)


def distance_to_zero(pixels: DataFrame, zero: str = "zero") -> DataFrame:
    """(image_id, y, x, distance): Euclidean, to the image's nearest pixel where the column zero is true.

    In two passes: the nearest zero in a pixel's column, then the least over its row by the lower envelope of the
    row's parabolas, in time that grows with the row. An image without zeros has none.
    """
    column = W.partitionBy("image_id", "x").orderBy("y")
    at = F.when(F.col(zero), F.col("y"))
    up = F.last(at, True).over(column.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(at, True).over(column.rowsBetween(0, W.unboundedFollowing))
    g = pixels.withColumn("_g", F.coalesce(F.least(F.col("y") - up, down - F.col("y")), F.lit(-1)).cast("double"))
    rows = g.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "_g"))).alias("_row"))  # a row's pixels
    rows = rows.filter(F.exists("_row", lambda s: s["_g"] >= 0)).withColumn("_nearest", _row_nearest(F.col("_row.x"), F.col("_row._g")))
    each = rows.select("image_id", "y", F.explode(F.arrays_zip(F.col("_row.x").alias("x"), F.col("_nearest").alias("_nearest"))).alias("_p"))
    return each.select("image_id", "y", F.col("_p.x").alias("x"), F.sqrt("_p._nearest").alias("distance"))


def _image_distances(key: tuple, pixels: pa.Table, places: pa.Table) -> pa.Table:
    """distance_to_places of an image that fits a tile."""
    y, x, at_y, at_x = (t.column(c).to_numpy().astype(np.int64) for t in (pixels, places) for c in ("y", "x"))
    if not len(y) or not len(at_y):
        return pa.table({"image_id": pa.array([], pa.int64()), "y": pa.array([], pa.int32()), "x": pa.array([], pa.int32()), "distance": pa.array([], pa.float64())})
    top, left = y.min(), x.min()
    there = np.zeros((int(y.max() - top) + 1, int(x.max() - left) + 1), bool)
    there[y - top, x - left] = True
    zero, at_y, at_x = np.zeros(there.shape, bool), at_y - top, at_x - left
    inside = (at_y >= 0) & (at_y < there.shape[0]) & (at_x >= 0) & (at_x < there.shape[1])
    zero[at_y[inside], at_x[inside]] = True
    distance = distances_in(zero & there, there)
    y, x = np.nonzero(np.isfinite(distance))
    return pa.table({"image_id": pa.repeat(key[0].cast(pa.int64()), len(y)), "y": pa.array((y + top).astype(np.int32)), "x": pa.array((x + left).astype(np.int32)), "distance": pa.array(distance[y, x])})


def distance_to_places(pixels: DataFrame, places: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """(image_id, y, x, distance): distance_to_zero of pixels, the zeros being those at the places (image_id, y, x) of their image.

    Sides are numbers, or columns of pixels where images differ. An image that fits a tile is measured in the task that
    has it, larger ones over tables.
    """
    keys = lambda df: df.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in "yx"], *(own_sides(width, height) if df is pixels else ()))
    pixels, places = keys(pixels), keys(places)
    fits = F.coalesce(F.greatest(side(width), side(height)) <= TILE, F.lit(False))
    small, large = pixels.filter(fits), pixels.filter(~fits)
    found = small.select("image_id", "y", "x").groupBy("image_id").cogroup(places.groupBy("image_id")).applyInArrow(_image_distances, "image_id long, y int, x int, distance double")
    if max(width, height) <= TILE if not own_sides(width, height) else not large.limit(1).count():
        return found
    flags = large.select("image_id", "y", "x").join(places.distinct().withColumn("zero", F.lit(True)), ["image_id", "y", "x"], "left")
    of_large = distance_to_zero(flags.withColumn("zero", F.coalesce("zero", F.lit(False))))
    return found.unionByName(of_large) if own_sides(width, height) else of_large


def _greatest_around(values: np.ndarray, reach: int) -> np.ndarray:
    """Of each place the greatest value of the square of 2 * reach + 1 places around."""
    for axis in (0, 1):
        wide = np.pad(values, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        values = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=axis).max(axis=-1)
    return values


def peaks_of(value: str):
    def peaks(table: pa.Table) -> pa.Table:
        """A tile's pixels that are the greatest of their window and above 0."""
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", value))
        grid = np.full((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), -np.inf)
        grid[y - y.min(), x - x.min()] = v
        top = _greatest_around(grid, int(table.column("_reach")[0].as_py()))[y - y.min(), x - x.min()]
        kept = pa.array((v == top) & (v > 0) & table.column("own").to_numpy())
        return table.select(["image_id", "y", "x", value, "_reach"]).filter(kept)

    return peaks


def spaced_peaks(value: str):
    def spaced(table: pa.Table) -> pa.Table:
        """An image's peaks from the greatest on, ties by row and column, each unless a kept one is within reach."""
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", value))
        reach, kept, cells = int(table.column("_reach")[0].as_py()), [], {}
        for i in np.lexsort((x, y, -v)).tolist():
            cy, cx = int(y[i]) // (reach + 1), int(x[i]) // (reach + 1)
            near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((cy + a, cx + b), ()))
            if all(abs(int(y[i]) - p) > reach or abs(int(x[i]) - q) > reach for p, q in near):
                cells.setdefault((cy, cx), []).append((int(y[i]), int(x[i])))
                kept.append(i)
        rows = table.take(pa.array(sorted(kept, key=lambda i: (y[i], x[i])), pa.int64())).select(["image_id", "y", "x"])
        return rows.append_column("marker", pa.array(range(1, len(kept) + 1), pa.int32()))

    return spaced


def local_maxima(pixels: DataFrame, reach: int | str, value: str = "distance", most: int | None = None) -> DataFrame:
    """(image_id, y, x, marker): pixels with the greatest value above 0 of their window, spaced, numbered from 1 an image by row and column.

    reach is one number, or a column with each image's own of up to most. Of the pixels that are the greatest of their
    window (2 * reach + 1 wide), taken from the greatest on, ties by row and column, one stays if no kept one
    lies in its window. Windows are looked at in tiles; one group of the spacing is the peaks of one image.
    """
    around = most if isinstance(reach, str) else reach
    image, at = (dict(pixels.dtypes)[c] for c in ("image_id", "y"))
    rows = pixels.select("image_id", "y", "x", F.col(value).cast("double").alias(value), (F.col(reach) if isinstance(reach, str) else F.lit(reach)).cast("int").alias("_reach"))
    rows = rows.dropna()
    found = in_tiles(rows, TILE, around).groupBy("image_id", "_ty", "_tx").applyInArrow(peaks_of(value), f"image_id {image}, y {at}, x {at}, {value} double, _reach int")
    return found.groupBy("image_id").applyInArrow(spaced_peaks(value), f"image_id {image}, y {at}, x {at}, marker int")
