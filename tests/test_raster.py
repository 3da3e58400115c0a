import inspect
import random

import pytest

from pointweave.functions import scalars
from pointweave.operators import annotations, filters, graph, names, points, regions, runs, segments, votes
from pyspark.sql import functions as F


def raster_of(spark, *pictures):
    rows = [(i, y, x, int(c)) for i, picture in enumerate(pictures) for y, line in enumerate(picture) for x, c in enumerate(line) if c != "."]
    return spark.createDataFrame(rows, "image_id long, y int, x int, class_id int")


def picture_of(df, height, width):
    cells = {(r["y"], r["x"]): str(r["class_id"]) for r in df.collect()}
    return ["".join(cells.get((y, x), ".") for x in range(width)) for y in range(height)]


NAMES = {
    "image.jpeg.jpeg": "image.jpeg", "image.JPG.JPG": "image.JPG", "image.jpg.JPG": "image.JPG", "image (1).jpg": "image.jpg", "image_copy.jpg": "image.jpg", "photocopy.jpg": "photo.jpg",
    "a.jpg.jpg.jpg": "a.jpg.jpg", "x-Copy2.png": "x.png", "noext": "noext", ".jpg.jpg": ".jpg", "b (2).jpg.jpg": "b.jpg",
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", scalars.normalized_name("name").alias("n"))
    assert {r["name"]: r["n"] for r in df.collect()} == NAMES


def test_scores_rounding_and_snapping(spark):
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 9)], "n int")
    assert [r[0] for r in n.select(scalars.point_score(F.col("n"))).collect()] == [0, 20, 30, 36, 38, 40, 40]
    q = spark.createDataFrame([(v,) for v in (0.0009, 0.001, 0.005, 0.01, 0.3, 0.5)], "q double")
    assert [r[0] for r in q.select(scalars.size_score(F.col("q"))).collect()] == [5, 15, 25, 30, 20, 10]
    v = spark.createDataFrame([(1,), (3,), (5,)], "v int")
    assert [tuple(r) for r in v.select(scalars.scaled("v", 0.5), scalars.truncated("v", 0.5)).collect()] == [(0, 0), (2, 1), (2, 2)]
    assert v.limit(1).select(scalars.snapped(F.lit(4.0), F.array(F.lit(3.0), F.lit(5.0)))).first()[0] == 3.0


def test_matching_rules(spark):
    images = spark.createDataFrame([("a.jpg.jpg", 1), ("b.jpg", 2), ("c.png", 3), (None, 4)], "image_name string, seq long")
    marks = spark.createDataFrame([("a.jpg", 1), ("b (1).jpg", 2), ("b_copy.jpg", 3), ("d.jpg", 4), (None, 5)], "annotation_name string, seq long")
    assert sorted(map(tuple, names.match_batch(images, marks).collect())) == [("a.jpg.jpg", "a.jpg"), ("b.jpg", "b (1).jpg")]
    assert sorted(map(tuple, names.match_app(images, marks).collect())) == [("a.jpg", "a.jpg.jpg", "a.jpg"), ("b.jpg", "b.jpg", "b_copy.jpg")]
    found = names.match_batch(images, marks)
    assert sorted(r[0] for r in names.points_without_images(marks.dropna(), found).collect()) == ["b_copy.jpg", "d.jpg"]
    numbered = names.numbered(images.dropna(), ["image_name"], "id", after=5)
    assert sorted((r["image_name"], r["id"]) for r in numbered.collect()) == [("a.jpg.jpg", 6), ("b.jpg", 7), ("c.png", 8)]


def test_votes_and_folds(spark):
    rows = [(1, 0, s, c, k) for s, order in ((7, (2, 1, 1, 2)), (8, (2, 1, 2, 1))) for k, c in enumerate(order)]
    located = spark.createDataFrame(rows, "image_id long, round int, segment_id long, class_id int, point_seq long")
    assert {r["segment_id"]: (r["class_id"], r["votes"]) for r in votes.majority_votes(located).collect()} == {7: (2, 4), 8: (2, 4)}
    assert {r["segment_id"]: r["class_id"] for r in votes.last_votes(located).collect()} == {7: 2, 8: 1}
    rounds = spark.createDataFrame([(1, 0, 0, 0, 1, 1), (1, 1, 0, 0, 2, 3), (1, 2, 0, 0, 3, 1)], "image_id long, round int, y int, x int, class_id int, votes long")
    assert [votes.fold(rounds, mode).first()["class_id"] for mode in ("fill", "overwrite", "confident")] == [1, 3, 2]


def test_fold_equals_the_sequential_rule(spark):
    rng = random.Random(1)
    rows = [(p, k, 0, 0, rng.randrange(1, 4), rng.randrange(1, 6)) for p in range(300) for k in range(5) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "image_id long, round int, y int, x int, class_id int, votes long")
    expected = {}
    for p, _, _, _, c, v in rows:
        if p not in expected or v >= 3:
            expected[p] = c
    assert {r["image_id"]: r["class_id"] for r in votes.fold(df, "confident", 3).collect()} == expected


def test_quality(spark):
    grid = [(1, float(r), float(c)) for r in (0, 10) for c in range(90)]
    seven = [(2, 0.0, float(c)) for c in range(100)] + [(2, 10.0, float(c)) for c in range(75)]
    few = [(3, float(i), float(i)) for i in range(89)] + [(3, None, 5.0)]
    got = {r["image_id"]: (r["points"], r["reason"]) for r in points.quality_reasons(spark.createDataFrame(grid + seven + few + [(4, 5.0, 5.0)] * 95, "image_id long, row double, col double")).collect()}
    assert got == {1: (180, "kept"), 2: (175, "poor spread"), 3: (89, "low count"), 4: (95, "poor spread")}


def test_components_by_connectivity(spark):
    runs_ = runs.encode_runs(raster_of(spark, ["1..", ".1.", "..2"], ["11.1", "1111"]))
    for connectivity, expected in ((8, 3), (4, 4)):
        labelled = regions.labelled_runs(runs_, connectivity)
        assert labelled.select("image_id", "region_id").distinct().count() == expected
        assert labelled.count() == runs_.count()
    measured = {r["image_id"]: r for r in regions.region_measures(regions.labelled_runs(runs_, 4)).filter("image_id = 1").collect()}
    assert (measured[1]["area"], measured[1]["bbox_w"], measured[1]["bbox_h"]) == (7, 4, 2)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 5000: 5000}


@pytest.mark.parametrize("seed", range(4))
def test_closing_against_pixels(spark, seed):
    rng = random.Random(seed)
    k, picture = (3, 4, 5, 5)[seed], ["".join(rng.choice("...." * (seed % 2 + 1) + "12") for _ in range(9)) for _ in range(7)]
    offsets = [(dy, dx) for dy, a, b in runs.ellipse_rows(k) for dx in range(a, b + 1)]
    h, w = 7, 9
    expected = [list(line) for line in picture]
    for c in "21":
        on = {(y, x) for y in range(h) for x in range(w) if picture[y][x] == c}
        grown = {(y, x) for y in range(h) for x in range(w) if any((y + a, x + b) in on for a, b in offsets)}
        kept = {(y, x) for y in range(h) for x in range(w) if all((y + a, x + b) in grown or not (0 <= y + a < h and 0 <= x + b < w) for a, b in offsets)}
        for y, x in kept:
            if picture[y][x] == ".":
                expected[y][x] = c
    assert picture_of(runs.closing(raster_of(spark, picture), k, w, h), h, w) == ["".join(line) for line in expected]


def test_runs_round_trip_and_resampling(spark):
    picture = ["1122", "1.22", "...."]
    raster = raster_of(spark, picture)
    assert picture_of(runs.decode_runs(runs.encode_runs(raster)), 3, 4) == picture
    assert picture_of(runs.resample_nearest(raster, (4, 3), (2, 2)), 2, 2) == ["12", "12"]
    assert picture_of(runs.resample_nearest(raster_of(spark, ["12"]), (2, 1), (5, 2)), 2, 5) == ["11122"] * 2


def test_cleanup_bridges_and_colour_groups(spark):
    picture = ["1111....1", "1111.....", "1111....2"]
    labelled = regions.labelled_runs(runs.encode_runs(raster_of(spark, picture)), 8)
    assert regions.without_speckles(runs.encode_runs(raster_of(spark, picture)), 5).groupBy().sum("x1").first()[0] == 9
    targets = regions.bridge_targets(labelled, 5)
    assert [tuple(r)[3:] for r in targets.collect()] == [(0, 8, 0, 3)]
    assert picture_of(regions.bridged(raster_of(spark, picture), targets, 9, 3), 3, 9) == ["111111111", "111111111", "1111....2"]
    colours = labelled.select("image_id", "region_id").distinct().withColumns({c: F.lit(1.0) for c in "bgr"})
    assert regions.colour_groups(labelled, colours, 5.0, 1).select("group_id").distinct().count() == 3
    assert regions.colour_groups(labelled, colours, 5.0, 6).select("group_id").distinct().count() == 2


@pytest.mark.parametrize("tile", [2, 64])
def test_bridge_targets_against_every_pixel(spark, monkeypatch, tile):
    monkeypatch.setattr(regions, "TILE", tile)
    rng = random.Random(tile)
    pictures = [["".join(rng.choice("11222.......") for _ in range(24)) for _ in range(14)] for _ in range(3)]
    labelled = regions.labelled_runs(runs.encode_runs(raster_of(spark, *pictures)), 8)
    measures = regions.region_measures(labelled).collect()
    held = labelled.select("image_id", "region_id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).collect()
    wanted = {}
    for m in measures:
        others = {o["region_id"] for o in measures if (o["image_id"], o["class_id"]) == (m["image_id"], m["class_id"]) and o["area"] >= 5}
        if m["area"] < 5 and others:
            from_y, from_x = m["centre_y"], m["centre_x"]
            near = [(abs(r["y"] - from_y), abs(r["x"] - from_x), r["y"], r["x"]) for r in held if r["image_id"] == m["image_id"] and r["region_id"] in others]
            reach = int(min(0.955 * abs(a - b) + 1.3693 * min(a, b) for a, b, *_ in near)) + 5
            _, y, x = min((a + b, y, x) for a, b, y, x in near if max(a, b) <= reach)
            wanted[m["image_id"], m["region_id"]] = (from_y, from_x, y, x)
    got = {(r["image_id"], r["region_id"]): (r["from_y"], r["from_x"], r["to_y"], r["to_x"]) for r in regions.bridge_targets(labelled, 5).collect()}
    assert got == wanted and len(got) > 5


def test_confidence_counts_unknown_labels(spark):
    raster = runs.encode_runs(raster_of(spark, ["11..", "11..", "...2"]))
    marks = spark.createDataFrame([(0, 0, 0, "A"), (0, 0, 1, "B"), (0, 1, 1, "?")], "image_id long, y int, x int, label string")
    lookup = spark.createDataFrame([("A", 1), ("B", 2)], "label string, class_id int")
    got = {r["class_id"]: r for r in regions.region_confidence(raster, marks, lookup, 12).collect()}
    assert (got[1]["points_in_region"], got[1]["matching_points"], got[1]["confidence"]) == (3, 1, 36 + 10 + 20)
    assert got[2]["confidence"] == 30
    assert regions.confidence_summary(regions.region_confidence(raster.limit(0), marks, lookup, 12)).first().asDict() == {"least": 0.0, "greatest": 0.0, "mean": 0.0, "regions": 0}


def test_polygons_and_export_floors(spark):
    assert annotations.outer_boundary({(y, x) for y in range(3) for x in range(4)}) == [(0, 0), (3, 0), (3, 2), (0, 2)]
    assert annotations.outer_boundary({(0, x) for x in range(12)}) == [(0, 0), (11, 0)]
    assert annotations.outer_boundary({(5, 5)}) == [(5, 5)]
    ring = {(y, x) for y in range(5) for x in range(5)} - {(2, 2)}
    assert annotations.outer_boundary(ring) == [(0, 0), (4, 0), (4, 4), (0, 4)]
    pictures = ["111", "111", "111"], ["11111", "11111"], ["1" * 12]
    labelled = regions.labelled_runs(runs.encode_runs(raster_of(spark, *pictures)), 8)
    rows = annotations.coco_annotations(labelled, 0.4, after=6).collect()
    assert [(r["id"], r["image_id"], r["bbox"], r["area"]) for r in rows] == [(7, 1, [0.0, 0.0, 12.5, 5.0], 62.5)]


# filters and segmenters


def pixels_of(spark, colour, h, w, images=1):
    return spark.createDataFrame([(i, y, x, *colour(y, x)) for i in range(images) for y in range(h) for x in range(w)], "image_id long, y int, x int, b int, g int, r int")


def test_distance_equals_every_pair(spark):
    rng = random.Random(2)
    cells = [(0, y, x, rng.random() < 0.1) for y in range(9) for x in range(11)]
    df = spark.createDataFrame(cells, "image_id long, y int, x int, zero boolean")
    zeros = [(y, x) for _, y, x, z in cells if z]
    for r in filters.distance_to_zero(df).collect():
        assert r["distance"] == pytest.approx(min(((r["y"] - a) ** 2 + (r["x"] - b) ** 2) ** 0.5 for a, b in zeros))
    ragged = df.filter("x % 3 <> 1 or zero")  # columns without zeros, rows of different lengths
    assert {(r["y"], r["x"]) for r in filters.distance_to_zero(ragged).collect()} == {(y, x) for _, y, x, z in cells if x % 3 != 1 or z}
    assert filters.distance_to_zero(df.withColumn("zero", F.lit(False))).count() == 0


def test_lower_envelope_equals_every_pair():
    rng = random.Random(5)
    for _ in range(200):
        at = sorted(rng.choices(range(40), k=rng.randint(1, 20)))
        parabolas = sorted((a, float(rng.randint(0, 30) ** 2)) for a in at)
        assert filters.lower_envelope(parabolas, list(range(-3, 44))) == [min((p - a) ** 2 + h for a, h in parabolas) for p in range(-3, 44)]


def test_smoothing_density_and_maxima(spark):
    flat = filters.smoothed(pixels_of(spark, lambda y, x: (40, 50, 60), 6, 8), 1.0, 8, 6, ["b"])
    assert all(r["b"] == pytest.approx(40) for r in flat.collect())
    marks = spark.createDataFrame([(0, 3, 4), (0, 3, 4), (0, 0, 0)], "image_id long, y int, x int")
    density = {(r["y"], r["x"]): r["density"] for r in filters.point_density(marks, 12, 10, 5).collect()}
    assert max(density.values()) == 1.0 and (9, 11) not in density and density[3, 4] > density[3, 5] > density[3, 6]
    hill = spark.createDataFrame([(0, y, x, 5.0 - abs(y - 2) - abs(x - 3)) for y in range(6) for x in range(8)], "image_id long, y int, x int, distance double")
    assert [tuple(r) for r in filters.local_maxima(hill, 2).collect()] == [(0, 2, 3, 1)]


@pytest.mark.parametrize("tile", [512, 5])
def test_filters_of_two_sizes_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(filters, "TILE", tile)
    rng = random.Random(tile)
    sizes = [(13, 9), (7, 12)]
    grids = [[[float(rng.randrange(256)) for _ in range(w)] for _ in range(h)] for w, h in sizes]
    pixels = spark.createDataFrame([(i, y, x, v, *sizes[i]) for i, g in enumerate(grids) for y, line in enumerate(g) for x, v in enumerate(line)], "image_id long, y int, x int, grey double, w int, h int")
    kernel = filters.gaussian(1.0)
    half = len(kernel) // 2
    got = {(r["image_id"], r["y"], r["x"]): r["grey"] for r in filters.smoothed(pixels, 1.0, "w", "h", ["grey"]).collect()}
    assert len(got) == pixels.count()
    for i, ((w, h), g) in enumerate(zip(sizes, grids)):
        at = lambda y, x: g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]  # noqa: B023, E731
        for y in range(h):
            for x in range(w):
                assert got[i, y, x] == pytest.approx(sum(a * b * at(y + j - half, x + k - half) for j, a in enumerate(kernel) for k, b in enumerate(kernel)))
        alone = pixels.filter(F.col("image_id") == i)
        both = filters.edge_pixels(pixels, "w", "h").filter(F.col("image_id") == i)
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, filters.edge_pixels(alone, w, h).collect())) != []
    marks = spark.createDataFrame([(0, 3, 4, 13, 9), (1, 0, 0, 7, 12), (1, 20, 2, 7, 12)], "image_id long, y int, x int, w int, h int")
    both = filters.point_density(marks, "w", "h", 5)
    for i, (w, h) in enumerate(sizes):
        alone = filters.point_density(marks.filter(F.col("image_id") == i), w, h, 5)
        assert sorted(map(tuple, both.filter(F.col("image_id") == i).collect())) == sorted(map(tuple, alone.collect())) != []


def test_edges_of_a_step(spark):
    df = pixels_of(spark, lambda y, x: (0, 0, 0) if x < 5 else (200, 200, 200), 8, 10).select("image_id", "y", "x", F.col("b").alias("grey"))
    found = {(r["y"], r["x"]) for r in filters.edge_pixels(df, 10, 8).collect()}
    assert {y for y, _ in found} == set(range(8)) and len({x for _, x in found}) == 1
    assert filters.edge_pixels(df.withColumn("grey", F.lit(7)), 10, 8).count() == 0


def test_segmenters_cover_every_pixel_once(spark):
    halves = pixels_of(spark, lambda y, x: (10, 10, 10) if x < 6 else (240, 240, 240), 8, 12)
    slic = segments.superpixels(halves, 6, 12, 8, rounds=3)
    assert slic.count() == 96 and slic.select("y", "x").distinct().count() == 96
    assert 2 <= slic.select("segment_id").distinct().count() <= 20
    apart = halves.unionByName(halves.withColumn("image_id", F.lit(1 << 32)))  # ids that differ in their upper half only
    graph_ = segments.graph_segments(apart, 10.0, 12, 8, sigma=0.3, min_size=10)
    assert graph_.groupBy("image_id").agg(F.count_distinct("segment_id").alias("n"), F.count("*").alias("p")).orderBy("image_id").collect() == [(0, 2, 96), (1 << 32, 2, 96)]
    graph_ = graph_.filter("image_id = 0")
    sides = graph_.groupBy("segment_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1")).collect()
    assert sorted((r["n"], r["x0"], r["x1"]) for r in sides) == [(48, 0, 5), (48, 6, 11)]


def test_flooding_goes_over_the_lowest_pass(spark):
    line = [0.0, 1.0, 5.0, 1.0, 0.0]
    heights = spark.createDataFrame([(0, 0, x, h) for x, h in enumerate(line)], "image_id long, y int, x int, height double")
    markers = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 4, 2)], "image_id long, y int, x int, marker int")
    assert [r["segment_id"] for r in segments.flooded(heights, markers).orderBy("x").collect()] == [1, 1, 1, 2, 2]


def test_markers_are_spaced_by_their_own_image(spark):
    rows = [(i, 0, x, h, 0.9 if i else 0.0) for i in (0, 1) for x, h in enumerate([0.0, 5.0] + [1.0] * 8 + [4.0, 0.0] + [0.0] * 8)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, distance double, density double")
    got = segments.spaced_markers(pixels.drop("density"), pixels, 10).orderBy("image_id", "x").collect()
    assert [tuple(r) for r in got if r["x"] in (1, 10)] == [(0, 0, 1, 1), (1, 0, 1, 1), (1, 0, 10, 2)]


def by_queue(heights, marks):
    """A flood by a priority queue of edges."""
    import heapq

    found, queue = dict(marks), []

    def push(p):
        for q in ((p[0], p[1] + 1), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0] - 1, p[1])):
            if q in heights and q not in found:
                heapq.heappush(queue, ((max(heights[p], heights[q]), min(p, q), max(p, q)), p, q))

    for p in marks:
        push(p)
    while queue:
        _, p, q = heapq.heappop(queue)
        if q not in found:
            found[q] = found[p]
            push(q)
    return found


@pytest.mark.parametrize("tile", [512, 9])
def test_flooding_equals_a_queue(spark, monkeypatch, tile):
    monkeypatch.setattr(segments, "TILE", tile)
    rng = random.Random(tile)
    pictures = [{(y, x): float(rng.randrange(1, 4 + 40 * (i % 2))) for y in range(30) for x in range(30) if rng.random() < 0.95} for i in range(3)]
    marks = [{p: k + 1 for k, p in enumerate(rng.sample(sorted(h), 9))} for h in pictures]
    marks[2] = {}
    heights = spark.createDataFrame([(i << 33, y, x, v) for i, h in enumerate(pictures) for (y, x), v in h.items()], "image_id long, y int, x int, height double")
    markers = spark.createDataFrame([(i << 33, y, x, k) for i, m in enumerate(marks) for (y, x), k in m.items()], "image_id long, y int, x int, marker int")
    got = {(r["image_id"] >> 33, r["y"], r["x"]): r["segment_id"] for r in segments.flooded(heights, markers).collect()}
    assert got == {(i, *p): k for i, h in enumerate(pictures) for p, k in by_queue(h, marks[i]).items()}


@pytest.mark.parametrize("tile", [512, 9])
def test_maxima_are_spaced_greedily(spark, monkeypatch, tile):
    monkeypatch.setattr(filters, "TILE", tile)
    rng = random.Random(tile)
    pictures = [{(0, x): float(x in (0, 4, 8)) for x in range(10)}] + [{(y, x): float(rng.randrange(0, 3)) for y in range(20) for x in range(25)} for _ in range(3)]
    reaches = [5, 1, 2, 4]
    rows = [(i, y, x, v, r) for i, (h, r) in enumerate(zip(pictures, reaches)) for (y, x), v in h.items()]
    got = filters.local_maxima(spark.createDataFrame(rows, "image_id long, y int, x int, distance double, reach int"), "reach", most=5)
    wanted = []
    for i, (h, r) in enumerate(zip(pictures, reaches)):
        near = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= r  # noqa: B023, E731
        kept = []
        for p in sorted(h, key=lambda p: (-h[p], p)):  # noqa: B023
            if h[p] > 0 and all(h[q] <= h[p] for q in h if near(p, q)) and not any(near(p, q) for q in kept):
                kept.append(p)
        wanted += [(i, *p, k + 1) for k, p in enumerate(sorted(kept))]
    assert sorted(map(tuple, got.collect())) == wanted and [w[2] for w in wanted if w[0] == 0] == [0, 8]


def test_ids_of_any_image_and_regions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(regions, "BLOCK_ROWS", 3)
    rng = random.Random(4)
    pictures = [["".join(rng.choice("11.2") for _ in range(18)) for _ in range(17)] for _ in range(2)] + [["1"]]
    raster = raster_of(spark, *pictures).withColumn("image_id", F.element_at(F.array(F.lit(-(1 << 40)), F.lit(7), F.lit(7 + (1 << 32))), (F.col("image_id") + 1).cast("int")))
    encoded = runs.encode_runs(raster)
    for connectivity in (8, 4):
        got = regions.labelled_runs(encoded, connectivity).collect()
        for image, picture in zip((-(1 << 40), 7, 7 + (1 << 32)), pictures):
            cells = {(y, x): c for y, line in enumerate(picture) for x, c in enumerate(line) if c != "."}
            first = {}
            for p in sorted(cells):  # each part is named by its first pixel
                todo = [p] if p not in first else []
                while todo:
                    q = todo.pop()
                    if q not in first:
                        first[q] = p
                        around = [(q[0] + a, q[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 8 or not a * b]
                        todo += [r for r in around if cells.get(r) == cells[q]]
            assert {(r["y"], r["x0"]): divmod(r["region_id"], 1 << 32) for r in got if r["image_id"] == image} == {(r["y"], r["x0"]): first[r["y"], r["x0"]] for r in got if r["image_id"] == image}
    assert regions.without_speckles(encoded, 2).filter(F.col("image_id") == 7 + (1 << 32)).count() == 0


def test_folds_of_runs_equal_those_of_pixels(spark):
    rng = random.Random(8)
    rows = [(i, r, y, x, rng.randrange(1, 4), rng.randrange(1, 6)) for i in (0, 1 << 40) for r in range(4) for y in range(3) for x in range(150, 420) if rng.random() < 0.8]
    pixels = spark.createDataFrame(rows, "image_id long, round int, y int, x int, class_id int, votes long")
    laid = runs.encode_runs(pixels, ("image_id", "round", "class_id", "votes"))
    for mode in ("fill", "overwrite", "confident"):
        wanted = sorted(map(tuple, runs.encode_runs(votes.fold(pixels, mode)).select("image_id", "class_id", "y", "x0", "x1").collect()))
        assert sorted(map(tuple, votes.fold_runs(laid, mode).select("image_id", "class_id", "y", "x0", "x1").collect())) == wanted
    plan = votes.fold_runs(laid, "fill")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(x0" not in plan


def test_resampled_runs_equal_resampled_pixels(spark):
    rng = random.Random(3)
    raster = raster_of(spark, *[["".join(rng.choice("112.") for _ in range(23)) for _ in range(11)] for _ in range(2)])
    for target in ((23, 11), (7, 5), (60, 4), (1, 1), (24, 30)):
        wanted = runs.encode_runs(runs.resample_nearest(raster, (23, 11), target)).select("image_id", "class_id", "y", "x0", "x1")
        sized = runs.encode_runs(raster).withColumns({"w": F.lit(23), "h": F.lit(11), "w2": F.lit(target[0]), "h2": F.lit(target[1])})
        for source, to in (((23, 11), target), (("w", "h"), ("w2", "h2"))):
            got = runs.resampled_runs(sized, source, to).select("image_id", "class_id", "y", "x0", "x1")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_closing_of_two_sizes_equals_each_alone(spark):
    pictures = ["1.1..2", "1.1..2", "....2."], ["11..11..11", "1........1"]
    raster = raster_of(spark, *pictures).withColumns({"w": F.when(F.col("image_id") == 0, 6).otherwise(10), "h": F.when(F.col("image_id") == 0, 3).otherwise(2)})
    both = runs.closing(raster, 3, "w", "h")
    for i, (w, h) in enumerate(((6, 3), (10, 2))):
        alone = runs.closing(raster.filter(F.col("image_id") == i), 3, w, h)
        assert picture_of(both.filter(F.col("image_id") == i), h, w) == picture_of(alone, h, w)


def test_flooding_has_no_cap_of_rounds():
    assert "rounds" not in inspect.signature(segments.flooded).parameters
    assert "rounds" not in inspect.signature(segments.graph_segments).parameters


def test_spread_cells_count_one_more_than_the_difference(spark):
    rows = [(1, float(r), float(c)) for r in (0, 1) for c in (0, 25, 26, 51, 76, 100)]  # columns 0..100: cells begin at 0, 25.25, 50.5, 75.75
    got = points.quality_reasons(spark.createDataFrame(rows, "image_id long, row double, col double"), 1).first()
    assert (got["points"], got["cells"], got["reason"]) == (12, 8, "kept")
    rows = [r for r in rows if r[2] != 26]  # 25 lies in the first cell, so none is left in the second
    got = points.quality_reasons(spark.createDataFrame(rows, "image_id long, row double, col double"), 1).first()
    assert (got["cells"], got["reason"]) == (6, "poor spread")


def test_last_label_entry_counts(spark):
    labels = spark.createDataFrame([("A", 9, 0), ("A", 3, 1), ("B", 2, 2), ("C", 0, 3)], "short_code string, class_id int, seq long")
    assert {tuple(r) for r in points.class_lookup(labels).collect()} == {("A", 3), ("B", 2)}


def test_gaps_of_colour_groups_are_closed(spark):
    raster = spark.createDataFrame([(0, y, x, 1) for y in range(6) for x in range(12) if x not in (5, 6)] + [(0, 8, 2, 2)], "image_id long, y int, x int, class_id int")
    pixels = spark.createDataFrame([(0, y, x, 10, 10, 10 if x < 6 else 12) for y in range(10) for x in range(12)], "image_id long, y int, x int, b int, g int, r int")
    merged = regions.colour_merged(raster, pixels, 5.0, 12, 10, gap=3)
    assert merged.filter("class_id = 1").count() >= 68 and merged.filter("class_id = 1 and x in (5, 6) and y between 1 and 4").count() == 8
    assert regions.colour_merged(raster, pixels, 1.0, 12, 10, gap=3).count() == raster.count()
    assert regions.colour_merged(raster, pixels, 5.0, 12, 10).count() == raster.count()
