"""Runs of one image, worked on in the task that has them: what runs, regions and votes do over tables for images of any size.

Runs of a row and class are apart from one another, and a pixel has one class. Images are of any place; only the frame,
width by height from 0, is closed or drawn in.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Sides up to which an image goes through its steps in one task.
SIDE = 256
#: A region's id is its first run's row times this, plus the run's first column.
ROW = 1 << 32
#: Pairs of small regions and runs that are looked at together.
PAIRS = 1 << 20


class Runs(NamedTuple):
    kind: np.ndarray
    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray

    @property
    def pixels(self) -> np.ndarray:
        return self.x1 - self.x0 + 1

    def at(self, rows: np.ndarray) -> Runs:
        return Runs(*(c[rows] for c in self))


class Cleanup(NamedTuple):
    """Settings of a cleanup; kernels as the rows of ellipse_rows, or None."""

    least_area: int
    small_region_merge: int
    kernel: list | None = None
    colour_distance: float = 0.0
    gap: int = 1
    colour_kernel: list | None = None


def runs_of(table: pa.Table) -> Runs:
    return Runs(*(table.column(c).to_numpy().astype(np.int64) for c in ("class_id", "y", "x0", "x1")))


def table_of(runs: Runs, like: pa.Table, same: list[str], **more: np.ndarray) -> pa.Table:
    """Runs as a table of the types that another has, whose columns of same are those of its first row."""
    made = {"class_id": runs.kind, "y": runs.y, "x0": runs.x0, "x1": runs.x1}
    columns = {c: pa.repeat(like.column(c)[0], len(runs.y)) for c in same} | {c: pa.array(v).cast(like.schema.field(c).type) for c, v in made.items()}
    return pa.table(columns | {c: pa.array(v) for c, v in more.items()})


def least_reached(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of size nodes the least that it hangs together with over the edges a, b."""
    least = np.arange(size)
    while True:
        low, found = np.minimum(least[a], least[b]), least.copy()
        for ends in (least[a], least[b], a, b):
            np.minimum.at(found, ends, low)
        while (found[found] != found).any():
            found = found[found]
        if (found == least).all():
            return least
        least = found


class _Lines:
    """Runs by class, row and column, in which those of a lower row that meet a stretch are found."""

    def __init__(self, runs: Runs, down: int, around: int):
        kind = np.unique(runs.kind, return_inverse=True)[1]
        self.order = np.lexsort((runs.x0, runs.y, kind))
        y, low = runs.y - runs.y.min(), int(runs.x0.min())
        self.wide = int(runs.x1.max()) - low + 2 * around + 2
        self.row = ((kind * (int(y.max()) + down + 1) + y) * self.wide + around - low)[self.order]  # a row's places follow those of the row before
        self.begin, self.end = runs.x0[self.order], runs.x1[self.order]

    def meeting(self, down: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of runs b, down rows below a, that end at a's low or later and begin at its high or before; both in the order of the lines."""
        row = self.row + down * self.wide
        first = np.searchsorted(self.row + self.end, row + low, "left")
        count = np.maximum(np.searchsorted(self.row + self.begin, row + high, "right") - first, 0)
        a = np.repeat(self.order, count)
        return a, self.order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(a))]


def labelled(runs: Runs, slack: int) -> np.ndarray:
    """The region of each run, by the place of the region's first one; regions are of one class, 8-connected with a slack of 1, 4-connected with 0."""
    if not len(runs.y):
        return runs.y
    by_place = np.lexsort((runs.x0, runs.y))  # runs are numbered in this order, so that a region is named by its first one
    number = np.empty(len(runs.y), np.int64)
    number[by_place] = np.arange(len(runs.y))
    lines = _Lines(runs, 1, slack)
    a, b = lines.meeting(1, lines.begin - slack, lines.end + slack)
    named = by_place[least_reached(len(runs.y), number[a], number[b])][number]
    return runs.y[named] * ROW + runs.x0[named]


def united(runs: Runs) -> Runs:
    """Runs of a class and row united where they overlap or touch, by class, row and column."""
    if not len(runs.y):
        return runs
    kind, y, x0, x1 = runs.at(np.lexsort((runs.x1, runs.x0, runs.y, runs.kind)))
    new = np.ones(len(y), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (y[1:] != y[:-1])
    line = np.cumsum(new) * (int(x1.max()) - int(x0.min()) + 3)
    reach = np.maximum.accumulate(x1 + line) - line
    new[1:] |= x0[1:] > reach[:-1] + 1
    first = np.flatnonzero(new)
    return Runs(kind[first], y[first], x0[first], reach[np.append(first[1:], len(y)) - 1])


def _painted(runs: Runs, top: int, left: int, height: int, width: int) -> np.ndarray:
    """Which pixels of a window of the image the runs hold."""
    y, x0, x1 = runs.y - top, np.maximum(runs.x0 - left, 0), np.minimum(runs.x1 - left, width - 1)
    held = (y >= 0) & (y < height) & (x0 <= x1)
    n, begin = (x1 - x0 + 1)[held], (y * width + x0)[held]
    out = np.zeros(height * width, bool)
    out[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = True
    return out.reshape(height, width)


def runs_on(grid: np.ndarray) -> Runs:
    """Runs of a grid's values; those below 0 stand for none."""
    height, width = grid.shape
    flat = np.full((height, width + 1), -1, np.int64)
    flat[:, :width] = grid
    flat = flat.ravel()
    cuts = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    begin, end = np.append(0, cuts), np.append(cuts, len(flat)) - 1
    held = flat[begin] >= 0
    y, x0 = np.divmod(begin[held], width + 1)
    return Runs(flat[begin[held]], y, x0, end[held] % (width + 1))


def _any_around(grid: np.ndarray, kernel: list, reach: int) -> np.ndarray:
    """Where a place of the kernel around is set; the grid is reach wider on all sides than the result."""
    height, width = grid.shape[0] - 2 * reach, grid.shape[1] - 2 * reach
    out = np.zeros((height, width), bool)
    for dy, a, b in kernel:
        for dx in range(a, b + 1):
            out |= grid[reach + dy : reach + dy + height, reach + dx : reach + dx + width]
    return out


def _fill_closed(fill: np.ndarray, runs: Runs, kernel: list, value: int) -> None:
    """Write the value where the closing of the runs covers the frame; outside pixels do not erode. Only the runs' surroundings are looked at."""
    reach = max(max(abs(v) for v in row) for row in kernel)
    top, left = max(int(runs.y.min()) - 2 * reach, 0), max(int(runs.x0.min()) - 2 * reach, 0)
    height, width = min(int(runs.y.max()) + 2 * reach + 1, fill.shape[0]) - top, min(int(runs.x1.max()) + 2 * reach + 1, fill.shape[1]) - left
    if height > 0 and width > 0:
        free = ~_any_around(_painted(runs, top - reach, left - reach, height + 2 * reach, width + 2 * reach), kernel, reach)
        cover = ~_any_around(np.pad(free, reach), kernel, reach)
        fill[top : top + height, left : left + width][cover] = value


def _filled(runs: Runs, fill: np.ndarray) -> Runs:
    """The runs and, on their background, the values of the frame's fill."""
    fill[_painted(runs, 0, 0, *fill.shape)] = -1
    new = runs_on(fill)
    return united(Runs(*(np.concatenate(c) for c in zip(runs, new))))


def closing(runs: Runs, kernel: list, width: int, height: int) -> Runs:
    """Background that any class's closing covers takes the lowest such class."""
    fill = np.full((height, width), -1, np.int64)
    for kind in np.unique(runs.kind)[::-1]:
        _fill_closed(fill, runs.at(runs.kind == kind), kernel, kind)
    return _filled(runs, fill)


def bridge_lines(runs: Runs, region: np.ndarray, threshold: int) -> np.ndarray:
    """Rows of (class, from y, from x, to y, to x): for every region below the threshold, from its truncated centre, the pixel
    of its class's other regions that is nearest by L1, first by row and column, in the window of the chamfer distance plus five."""
    own, n = np.unique(region, return_inverse=True)[1], runs.pixels
    area = np.bincount(own, n)
    centre = np.trunc(np.bincount(own, n * runs.y) / area).astype(np.int64), np.trunc(np.bincount(own, n * (runs.x0 + runs.x1)) / (2 * area)).astype(np.int64)
    kind_of, lines = np.zeros(len(area), np.int64), []
    kind_of[own] = runs.kind
    for kind in np.unique(kind_of[area < threshold]):
        small = np.flatnonzero((kind_of == kind) & (area < threshold))
        large = runs.at((runs.kind == kind) & (area[own] >= threshold))
        if not len(large.y):
            continue
        large = large.at(np.lexsort((large.x0, large.y)))
        for some in np.array_split(small, -(-len(small) * len(large.y) // PAIRS)):
            from_y, from_x = (c[some][:, None] for c in centre)
            near = np.maximum(large.x0, np.minimum(large.x1, from_x))
            dx, dy = np.abs(near - from_x), np.abs(large.y - from_y)
            reach = np.floor((0.955 * np.abs(dx - dy) + 1.3693 * np.minimum(dx, dy)).min(axis=1))[:, None] + 5
            inside = (dx <= reach) & (dy <= reach)
            to, held = np.where(inside, dx + dy, np.iinfo(np.int64).max).argmin(axis=1), inside.any(axis=1)  # far off, the window may hold none
            lines.append(np.stack([np.full(len(some), kind), from_y[:, 0], from_x[:, 0], large.y[to], near[np.arange(len(some)), to]], 1)[held])
    return np.concatenate(lines) if lines else np.zeros((0, 5), np.int64)


def _half_up(v: np.ndarray) -> np.ndarray:
    whole = np.floor(np.abs(v))
    return (np.sign(v) * (whole + (np.abs(v) - whole >= 0.5))).astype(np.int64)


def bridged(runs: Runs, region: np.ndarray, threshold: int, width: int, height: int) -> Runs:
    """A line two pixels wide from each region below the threshold to its target, on background only, lowest class first."""
    kind, from_y, from_x, to_y, to_x = bridge_lines(runs, region, threshold).T
    steps = np.maximum(np.abs(to_y - from_y), np.abs(to_x - from_x))
    own = np.repeat(np.arange(len(kind)), steps + 1)
    i = np.arange(len(own)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    y, x = (_half_up(a[own] + (b - a)[own] * i / np.maximum(steps, 1)[own]) for a, b in ((from_y, to_y), (from_x, to_x)))
    y, x, kind = np.concatenate([y, y + 1]), np.tile(x, 2), np.tile(kind[own], 2)
    drawn = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    y, x, kind = y[drawn], x[drawn], kind[drawn]
    fill = np.full((height, width), -1, np.int64)
    for value in np.unique(kind)[::-1]:
        at = kind == value
        fill[y[at], x[at]] = fill[y[at], np.minimum(x[at] + 1, width - 1)] = value
    return _filled(runs, fill)


def run_at(runs: Runs, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of the run that each place lies in, -1 for background."""
    if not len(runs.y):
        return np.full(len(y), -1)
    y, x, order = y.astype(np.int64), x.astype(np.int64), np.lexsort((runs.x0, runs.y))
    low = min(int(runs.x0.min()), int(x.min(initial=0)))
    at = order[np.maximum(np.searchsorted((runs.y * ROW + runs.x0 - low)[order], y * ROW + x - low, "right") - 1, 0)]
    return np.where((runs.y[at] == y) & (runs.x0[at] <= x) & (x <= runs.x1[at]), at, -1)


def colour_merged(runs: Runs, settings: Cleanup, pixels: tuple, width: int, height: int) -> Runs:
    """The background between regions of a class that lie up to gap pixels apart and are like-coloured, closed group by group, lowest class first."""
    own = np.unique(labelled(runs, 1), return_inverse=True)[1]
    size = int(own.max()) + 1
    at = run_at(runs, *pixels[:2])
    of, seen = own[at[at >= 0]], np.bincount(own[at[at >= 0]], minlength=size)
    means = [np.bincount(of, v[at >= 0], size) / np.maximum(seen, 1) for v in pixels[2:]]
    lines = _Lines(runs, settings.gap, settings.gap)
    met = [lines.meeting(0, lines.end + 1, lines.end + settings.gap), *(lines.meeting(d, lines.begin, lines.end) for d in range(1, settings.gap + 1))]
    a, b = (own[np.concatenate(ends)] for ends in zip(*met))
    close = (a != b) & (seen[a] > 0) & (seen[b] > 0) & (np.sqrt(sum((m[a] - m[b]) ** 2 for m in means)) < settings.colour_distance)
    group = least_reached(size, a[close], b[close])
    several = np.flatnonzero(np.bincount(group, minlength=size) > 1)
    kind_of, of_run = np.zeros(size, np.int64), group[own]
    kind_of[of_run] = runs.kind
    fill = np.full((height, width), -1, np.int64)
    for one in several[np.argsort(-kind_of[several], kind="stable")]:
        _fill_closed(fill, runs.at(of_run == one), settings.colour_kernel, kind_of[one])
    return _filled(runs, fill)


def cleaned(runs: Runs, settings: Cleanup, width: int, height: int, pixels: tuple | None = None) -> Runs:
    """Closing, then speckle removal, then bridges from small regions, then gaps between like-coloured ones; pixels are (y, x, b, g, r)."""
    if settings.kernel:
        runs = closing(runs, settings.kernel, width, height)
    region = labelled(runs, 1)
    own = np.unique(region, return_inverse=True)[1]
    kept = np.bincount(own, runs.pixels)[own] >= settings.least_area if len(own) else own
    runs, region = runs.at(kept), region[kept]
    if len(region) and settings.small_region_merge > settings.least_area:
        runs = bridged(runs, region, settings.small_region_merge, width, height)
    if len(region) and settings.colour_distance > 0 and pixels is not None:
        runs = colour_merged(runs, settings, pixels, width, height)
    return runs


def folded(runs: Runs, order: np.ndarray) -> Runs:
    """Runs of one class a pixel from those of all rounds: where they overlap, those of the greatest order show."""
    top, left = int(runs.y.min()), int(runs.x0.min())
    width, runs = int(runs.x1.max()) - left + 1, runs.at(np.argsort(order, kind="stable"))
    grid, n = np.full((int(runs.y.max()) - top + 1) * width, -1, np.int64), runs.pixels
    begin = (runs.y - top) * width + runs.x0 - left
    grid[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = np.repeat(runs.kind, n)  # the last of a place stays
    found = runs_on(grid.reshape(-1, width))
    return Runs(found.kind, found.y + top, found.x0 + left, found.x1 + left)


def measured(runs: Runs, slack: int, points: tuple) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The number of each run's region in a table of regions: class_id, region_id, size, points_in_region, matching_points; points are (y, x, class)."""
    regions, first, own = np.unique(labelled(runs, slack), return_index=True, return_inverse=True)
    kinds, at = runs.kind[first], run_at(runs, *points[:2])
    inside = own[at[at >= 0]]
    matching = inside[points[2][at >= 0] == kinds[inside]]
    counts = {"points_in_region": inside, "matching_points": matching}
    whole = {"class_id": kinds.astype(np.int32), "region_id": regions, "size": np.bincount(own, runs.pixels, len(regions)).astype(np.int64)}
    return own, whole | {c: np.bincount(v, minlength=len(regions)) for c, v in counts.items()}
