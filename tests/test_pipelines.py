import pytest

from pointweave.plans import pipelines
from pyspark.sql import functions as F


def test_rounds_to_annotations(spark):
    h, w = 16, 20
    grid = spark.range(2).select(F.col("id").alias("image_id")).crossJoin(spark.range(h).select(F.col("id").cast("int").alias("y"))).crossJoin(spark.range(w).select(F.col("id").cast("int").alias("x")))
    segments = grid.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("segment_id", F.when(F.col("round") == 0, F.floor(F.col("y") / 4) * 100 + F.floor(F.col("x") / 4)).otherwise(F.floor(F.col("x") / 10)))
    marks = spark.createDataFrame([(0, 1, 1, "A", 1), (0, 9, 15, "B", 2), (0, 30, 2, "A", 3), (0, 2, 2, "?", 4), (1, 0, 0, "B", 5)], "image_id long, y int, x int, label string, point_seq long")
    labelset = spark.createDataFrame([("A", 1, "a"), ("B", 2, "b")], "short_code string, class_id int, name string")
    raster = pipelines.label_rounds(segments, marks, labelset, w, h)
    assert raster.filter("image_id = 0").groupBy("class_id").count().orderBy("class_id").collect() == [(1, 160), (2, 160)]
    clean = pipelines.merged_raster(raster, w, h, least_area=20, small_region_merge=30, kernel=3)
    images = spark.createDataFrame([(0, "a.jpg", w, h), (1, "b.jpg", w, h), (2, "c.jpg", w, h)], "image_id long, image_name string, width int, height int")
    out = pipelines.export(clean, images, labelset, marks, 50.0)
    assert [r["id"] for r in out["images"].orderBy("id").collect()] == [0, 1] and out["categories"].count() == 2
    rows = out["annotations"].orderBy("id").collect()
    assert [(r["id"], r["image_id"], r["category_id"], r["area"]) for r in rows] == [(1, 0, 1, 160.0), (2, 0, 2, 160.0), (3, 1, 2, 160.0)]


def test_points_reach_images_by_name_and_quality(spark):
    images = spark.createDataFrame([(1, "a.jpg.jpg"), (2, "b.jpg"), (3, "c.jpg")], "image_id long, image_name string")
    marks = spark.createDataFrame([(n, y, x, "A", x) for n in ("a.jpg", "c.jpg") for y in (0, 5) for x in range(8 if n == "a.jpg" else 2)], "image_name string, y int, x int, label string, point_seq long")
    assert [r["image_id"] for r in pipelines.matched_points(images, marks, 10).select("image_id").distinct().collect()] == [1]
    done = spark.createDataFrame([("a.jpg.jpg",)], "file_name string")
    assert pipelines.matched_points(images, marks, 10, done).count() == 0


def test_batch_of_two_sizes(spark):
    images = spark.createDataFrame([(1, "a.jpg", 8, 6), (2, "b.jpg", 16, 4), (3, "c.jpg", 8, 6)], "image_id long, image_name string, width int, height int")
    marks = spark.createDataFrame([(n, y, x, "A", y * 100 + x) for n, h, w in (("a.jpg.jpg", 6, 8), ("b.jpg", 4, 16)) for y in range(h) for x in range(w)], "image_name string, y int, x int, label string, point_seq long")
    labelset = spark.createDataFrame([("A", 1, "a")], "short_code string, class_id int, name string")
    segments = spark.createDataFrame([(i, 0, y, x, 1) for i, h, w in ((1, 6, 8), (2, 4, 16)) for y in range(h) for x in range(w)], "image_id long, round int, y int, x int, segment_id long")
    out = pipelines.batch_export(images, marks, labelset, segments, least_points=10, least_area=10, small_region_merge=0, kernel=3, least_confidence=10.0)
    assert [(r["id"], r["image_id"], r["area"]) for r in out["annotations"].orderBy("id").collect()] == [(1, 1, 48.0), (2, 2, 64.0)]
    assert tuple(out["summary"].first()) == (3, 2, 1, 2, 0)


def test_resized_export_counts_in_the_images_own_pixels(spark):
    images = spark.createDataFrame([(1, "a.jpg", 8, 6), (2, "b.jpg", 10, 10)], "image_id long, image_name string, width int, height int")
    marks = spark.createDataFrame([(n, y, x, "A", y * 100 + x) for n, h, w in (("a.jpg", 6, 8), ("b.jpg", 10, 10)) for y in range(h) for x in range(w)], "image_name string, y int, x int, label string, point_seq long")
    labelset = spark.createDataFrame([("A", 1, "a")], "short_code string, class_id int, name string")
    segments = spark.createDataFrame([(i, 0, y, x, 1) for i, h, w in ((1, 3, 4), (2, 5, 5)) for y in range(h) for x in range(w)], "image_id long, round int, y int, x int, segment_id long")
    settings = dict(least_points=10, least_area=1, small_region_merge=0, kernel=0)
    out = pipelines.resized_export(images, marks, labelset, segments, 0.5, **settings)
    assert sorted(map(tuple, out["images"].collect())) == [(1, "a.jpg", 8, 6), (2, "b.jpg", 10, 10)]
    rows = {r["image_id"]: (r["area"], r["bbox"], r["segmentation"]) for r in out["annotations"].collect()}
    assert rows[1] == (48.0, [0.0, 0.0, 8.0, 6.0], [[0.0, 0.0, 7.0, 0.0, 7.0, 5.0, 0.0, 5.0]]) and rows[2][:2] == (100.0, [0.0, 0.0, 10.0, 10.0])
    multiplied = pipelines.batch_export(images, marks, labelset, segments, scale=0.5, **settings)["annotations"]
    assert {r["image_id"]: r["segmentation"] for r in multiplied.collect()}[1] == [[0.0, 0.0, 6.0, 0.0, 6.0, 4.0, 0.0, 4.0]]


def halves(spark, sizes):
    """Images whose left half is dark and right half is light, and a point in each half."""
    rows = [(i, y, x, *([20] * 3 if x < w // 2 else [230] * 3), w, h) for i, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int, w int, h int")
    marks = spark.createDataFrame([(i, h // 2, x, label, k, w, h) for i, (w, h) in sizes.items() for k, (x, label) in enumerate(((1, "A"), (w - 2, "B"), (w - 2, "?")))], "image_id long, y int, x int, label string, point_seq long, w int, h int")
    labelset = spark.createDataFrame([("A", 1, "a"), ("B", 2, "b")], "short_code string, class_id int, name string")
    return pixels, marks, labelset


@pytest.mark.parametrize("method", ["superpixel", "hybrid", "graph_first", "graph"])
def test_labels_follow_the_halves_of_images_of_two_sizes(spark, method):
    sizes = {3: (12, 8), 1 << 40: (8, 6)}
    pixels, marks, labelset = halves(spark, sizes)
    given = (pixels, marks, labelset, "w", "h")
    if method == "graph":
        raster = pipelines.graph_labels(*given, scales=(5, 20), overwrite=True, least_votes=1)
    elif method == "superpixel":
        raster = pipelines.superpixel_labels(*given, counts=(2,))
    elif method == "hybrid":
        raster = pipelines.hybrid_labels(*given, rounds=[("superpixel", 2), ("graph", 5)])
    else:
        raster = pipelines.graph_first_labels(*given, discovery_scale=5, fill_values=(2,))
    got = {(r["image_id"], r["y"], r["x"]): r["class_id"] for r in raster.collect()}
    for i, (w, h) in sizes.items():
        own = {p[1:]: c for p, c in got.items() if p[0] == i}
        assert own[h // 2, 1] == 1 and own[h // 2, w - 2] == 2
        assert all((c == 1) == (x < w // 2) for (_, x), c in own.items())
        if method in ("graph", "graph_first"):  # a segment a half
            assert len(own) == w * h


def test_adaptive_labels_of_all_levels_equal_each_level_alone(spark):
    sizes = {3: (40, 24), 5: (24, 32)}
    pixels, marks, labelset = halves(spark, sizes)
    both = pipelines.adaptive_labels(pixels, marks, labelset, "w", "h", scales=(1.0, 0.5), min_distance=6)
    got = {tuple(r) for r in both.select("image_id", "y", "x", "class_id").collect()}
    wanted = {}
    for scale in (1.0, 0.5):  # a loop of plans, an image and a level at a time; the first level with a label stays
        for i, (w, h) in sizes.items():
            own = lambda df: df.filter(F.col("image_id") == i).drop("w", "h")  # noqa: B023, E731
            alone = pipelines.adaptive_labels(own(pixels), own(marks), labelset, w, h, scales=(scale,), min_distance=6)
            wanted |= {(r["image_id"], r["y"], r["x"]): r["class_id"] for r in alone.collect() if (r["image_id"], r["y"], r["x"]) not in wanted}
    assert got == {(*p, c) for p, c in wanted.items()}
    for i, (w, h) in sizes.items():
        assert wanted[i, h // 2, 1] == 1 and wanted[i, h // 2, w - 2] == 2


def test_batch_export_segments_the_images_it_keeps(spark):
    sizes = {3: (24, 20), 4: (32, 16)}
    pixels, _, labelset = halves(spark, sizes)
    images = spark.createDataFrame([(3, "a.jpg", 24, 20), (4, "b.jpg", 32, 16), (9, "c.jpg", 5, 5)], "image_id long, image_name string, width int, height int")
    marks = spark.createDataFrame([(n, y, x, "A" if x < w // 2 else "B", y * 100 + x) for n, (w, h) in (("a.jpg", sizes[3]), ("b.jpg", sizes[4])) for y in range(h) for x in range(w)], "image_name string, y int, x int, label string, point_seq long")
    out = pipelines.batch_export(images, marks, labelset, None, least_points=10, voting="majority", least_area=5, small_region_merge=0, kernel=0, scale=0.5, pixels=pixels.drop("w", "h"), rounds=[("graph", 5)])
    rows = sorted((r["image_id"], r["category_id"], r["bbox"], r["area"]) for r in out["annotations"].collect())
    assert rows == [(3, 1, [0.0, 0.0, 12.0, 20.0], 240.0), (3, 2, [12.0, 0.0, 12.0, 20.0], 240.0), (4, 1, [0.0, 0.0, 16.0, 16.0], 256.0), (4, 2, [16.0, 0.0, 16.0, 16.0], 256.0)]
    assert tuple(out["summary"].first()) == (3, 2, 0, 2, 0)


def test_report_by_class_after_the_cleanup(spark):
    picture = ["1111.2", "1111..", "..1...", "......"]
    raster = spark.createDataFrame([(7, y, x, int(c)) for y, line in enumerate(picture) for x, c in enumerate(line) if c != "."] + [(7, 3, 5, 1)], "image_id long, y int, x int, class_id int")
    marks = spark.createDataFrame([(7, 0, 0, "A"), (7, 1, 1, "B")], "image_id long, y int, x int, label string")
    labelset = spark.createDataFrame([("A", 1, "a"), ("B", 2, None)], "short_code string, class_id int, name string")
    rows = pipelines.image_report(raster, marks, labelset, 6, 4, least_area=2, small_region_merge=0, kernel=0).collect()
    assert [(r["rank"], r["class_id"], r["name"], r["before"], r["after"], r["reduced"], r["all_before"], r["all_after"]) for r in rows] == [(1, 1, "a", 2, 1, 1, 3, 1)]
    assert rows[0]["coverage"] == 37.5 and rows[0]["least"] == rows[0]["greatest"] == 30 + 15 + 20
