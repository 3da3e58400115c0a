"""Work and memory of the derived tables follow the images, not the tables' size."""

import random

import pytest

from pointweave.functions import scalars
from pointweave.operators import filters, segments
from pointweave.plans import queries
from pointweave.sources import derived
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pixels", "segment_runs", "segments"])
def test_images_are_dealt_to_tasks(spark, monkeypatch, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(derived, "IMAGES_A_TASK", 2)
    try:
        made = derived.view(spark, SF, name)
        images = made.select("image_id").distinct().count()
        per = made.select(F.spark_partition_id().alias("p"), "image_id").distinct().groupBy("p").count()
        assert made.rdd.getNumPartitions() >= images / 2 and per.count() > 1
        assert sorted(made.limit(0).columns) == sorted(spark.sql(f"{derived.sql_with(name)} select * from {name}").columns)
        plain = spark.sql(f"{derived.sql_with(name)} select * from {name}")
        assert made.exceptAll(plain).count() == 0 and plain.exceptAll(made).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _exchanges(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["resample_bilinear", "colour_planes"])
def test_pixels_are_not_shuffled(spark, name):
    assert not [e for e in _exchanges(queries.ALL[name](spark, SF)) if "ENSURE_REQUIREMENTS" in e and "image_id" in e and "suppkey" not in e]


def test_colours_step_by_step_equal_the_expression(spark):
    draw = random.Random(3)
    rows = spark.createDataFrame([(draw.randrange(256), draw.randrange(256), draw.randrange(256)) for _ in range(300)], "b int, g int, r int")
    both = scalars.with_lab(rows, "steps").withColumn("one", scalars.lab(F.col("b"), F.col("g"), F.col("r"))).collect()
    assert all(r.steps == r.one for r in both)


def test_nearest_zeros_beyond_the_steps(spark, monkeypatch):
    monkeypatch.setattr(filters, "STEPS", 4)
    import numpy as np

    draw = random.Random(5)
    rows = np.array([[draw.choice([np.inf, np.inf, np.inf, np.inf, np.inf, float(draw.randrange(9) ** 2)]) for _ in range(40)] for _ in range(60)])
    rows = rows[np.isfinite(rows).any(axis=1)]
    every = np.array([[min((x - a) ** 2 + h for a, h in enumerate(row)) for x in range(40)] for row in rows])
    assert (filters._nearest_in_rows(rows) == every).all()


def test_cleanup_goes_by_runs_not_pixels(spark):
    """A raster of ten million pixels a row is closed and bridged as what it is, a few runs."""
    from pointweave.operators import regions, runs

    wide = 10_000_000
    rows = [(1, 1, y, 0, wide // 2) for y in range(3)] + [(1, 1, y, wide // 2 + 2, wide - 1) for y in range(3)] + [(1, 2, 6, 5, 5)]
    raster = spark.createDataFrame(rows, "image_id long, class_id int, y int, x0 int, x1 int")
    closed = {tuple(r) for r in runs.closing_runs(raster, 3, wide, 8).select("class_id", "y", "x0", "x1").collect()}
    open_below = {(1, 2, 0, wide // 2), (1, 2, wide // 2 + 2, wide - 1)}  # the cross reaches the free row
    assert closed == {(1, y, 0, wide - 1) for y in range(2)} | open_below | {(2, 6, 5, 5)}
    targets = spark.createDataFrame([(1, 1, 0, 0, wide // 2 + 1, 2, wide // 2 + 1)], "image_id long, class_id int, region_id long, from_y int, from_x int, to_y int, to_x int")
    drawn = {tuple(r) for r in regions.bridged_runs(raster, targets, wide, 8).select("class_id", "y", "x0", "x1").collect()}
    assert drawn == {(1, y, 0, wide - 1) for y in range(3)} | {(1, 3, wide // 2 + 1, wide // 2 + 2), (2, 6, 5, 5)}


def _pictures(spark, seed: int, sides: list[tuple[int, int]], levels: int = 4):
    """Images of their own sides (w, h) with patches of few colours and noise, and one in fifty pixels missing."""
    draw, rows = random.Random(seed), []
    for i, (w, h) in enumerate(sides):
        patch = {}
        for y in range(h):
            for x in range(w):
                base = patch.setdefault((y // 7, x // 9), [40 * draw.randrange(levels) for _ in "bgr"])
                if draw.random() < 0.98:
                    rows.append((i << 33, y, x, *[v + draw.randrange(12) for v in base], w, h))
    return spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int, w int, h int")


def _by_tables_and_in_tasks(spark, monkeypatch, make, sides):
    """Segments of images of which all, one or none go through the iterations over tables."""
    found = []
    for tile in (512, sorted(max(s) for s in sides)[-2], 1):
        monkeypatch.setattr(segments, "TILE", tile)
        found.append(sorted(map(tuple, make().select("image_id", "y", "x", "segment_id").collect())))
    return found


def test_graph_segments_in_a_task_equal_the_tables(spark, monkeypatch):
    sides = [(23, 17), (9, 30)]
    pixels = _pictures(spark, 1, sides)
    whole, mixed, tables = _by_tables_and_in_tasks(spark, monkeypatch, lambda: segments.graph_segments(pixels, 100.0, "w", "h", min_size=5), sides)
    assert whole == mixed == tables and len({r[3] for r in whole if r[0] == 0}) > 2


def test_superpixels_in_a_task_equal_the_tables(spark, monkeypatch):
    sides = [(23, 17), (9, 30)]
    pixels = _pictures(spark, 2, sides)
    whole, mixed, tables = _by_tables_and_in_tasks(spark, monkeypatch, lambda: segments.superpixels(pixels, 12, "w", "h", rounds=4), sides)
    assert whole == mixed == tables and len({r[3] for r in whole if r[0] == 0}) > 5


def test_adaptive_segments_in_a_task_equal_the_tables(spark, monkeypatch):
    sides = [(33, 37), (21, 50), (20, 20)]
    pixels, draw = _pictures(spark, 3, sides, levels=7), random.Random(4)
    marks = [(i << 33, draw.randrange(h), draw.randrange(w), w, h) for i, (w, h) in enumerate(sides[:2]) for _ in range(4)]
    points = spark.createDataFrame(marks, "image_id long, y int, x int, w int, h int")
    whole, mixed, tables = _by_tables_and_in_tasks(spark, monkeypatch, lambda: segments.adaptive_segments(pixels, points, "w", "h", 4), sides)
    assert whole == mixed == tables and len({r[3] for r in whole if r[0] == 0}) > 2


@pytest.mark.parametrize("name", ["graph_segments", "slic_segments", "watershed_segments"])
def test_segmenters_of_small_images_iterate_inside_tasks(spark, monkeypatch, name):
    """Nothing is written step by step for images that fit a tile."""
    kept = []
    for module in ("segments", "filters", "graph"):
        monkeypatch.setattr(f"pointweave.operators.{module}.staged", lambda df, name="step": kept.append(name) or df)
    assert queries.ALL[name](spark, SF).columns == ["image_id", "segments", "pixels", "largest"]
    assert not kept


def _with_settings(spark, values: dict[str, str], do):
    """What do() gives with these settings of the session, all of which it finds again as they were."""
    names = [*values, "spark.sql.shuffle.partitions"]
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        return do()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("given, shuffled, read", [(("64MB", "134217728b"), 8 << 20, 16 << 20), (("3m", "5m"), "3m", "5m")])
def test_tasks_of_later_steps_are_bounded(spark, given, shuffled, read):
    settings = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")

    def after():
        derived.view(spark, SF, "segment_runs")
        return tuple(spark.conf.get(k) for k in settings)

    assert _with_settings(spark, dict(zip(settings, given)), after) == (str(shuffled), str(read))


def test_shuffled_runs_are_not_put_together_in_few_tasks(spark, monkeypatch):
    """The shuffle by region of all runs goes to tasks of a bounded share, however many partitions Spark could put together."""
    monkeypatch.setattr(derived, "SHUFFLED_A_TASK", 4 << 10, raising=False)
    monkeypatch.setattr(derived, "READ_A_TASK", 4 << 20, raising=False)
    monkeypatch.setattr(derived, "IMAGES_A_TASK", 1)
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m", "spark.sql.files.maxPartitionBytes": "128m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}

    def tasks():
        labelled = queries._labelled(spark, SF)
        scanned = labelled.rdd.getNumPartitions()
        made = labelled.groupBy("image_id", "region_id").agg(F.sum("x1")).select(F.spark_partition_id().alias("p")).distinct().count()
        return scanned, made

    scanned, made = _with_settings(spark, settings, tasks)
    assert scanned > 4 and made > 1


def test_confidence_filter_labels_once_and_takes_no_pixels(spark, monkeypatch):
    from pointweave.operators import regions

    calls, label = [], regions.labelled_runs
    monkeypatch.setattr(regions, "labelled_runs", lambda *a: calls.append(a) or label(*a))
    out = queries.ALL["confidence_filter"](spark, SF)
    assert len(calls) == 1 and "sequence(x0" not in out._jdf.queryExecution().analyzed().toString()


def test_labelled_runs_are_not_copied(spark):
    """document_read_back and others read the runs as the tasks that made them wrote them; a copy is of fewer, larger files."""
    labelled = queries._labelled(spark, SF)
    assert labelled.inputFiles() and all("/blocks/" in f for f in labelled.inputFiles())


def _class_runs(spark, seed: int, sides: list[tuple[int, int]], classes: int = 3):
    """Class runs of images of their own sides (w, h): patches, specks and background."""
    draw, rows = random.Random(seed), []
    for i, (w, h) in enumerate(sides):
        patch = {}
        for y in range(h):
            for x in range(w):
                kind = patch.setdefault((y // 6, x // 7), draw.choice([0, 0, *range(1, classes + 1)]))
                kind = draw.randrange(classes + 1) if draw.random() < 0.06 else kind
                if kind:
                    rows.append((i << 33, y, x, kind, w, h))
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, class_id int, w int, h int")
    from pointweave.operators import runs

    return runs.encode_runs(pixels, ("image_id", "class_id", "w", "h"))


_CELLS = ("image_id", "class_id", "y", "x0", "x1")


def _in_tasks_and_by_tables(monkeypatch, make, sides: list[tuple[int, int]]):
    """What make() gives with all, one or none of the images in tasks."""
    from pointweave.operators import image_runs

    found = []
    for most in (256, sorted(max(s) for s in sides)[-2], 1):
        monkeypatch.setattr(image_runs, "SIDE", most)
        found.append(sorted(map(tuple, make().select(*_CELLS).collect())))
    return found


SIDES = [(37, 29), (21, 34)]


@pytest.mark.parametrize("k", [1, 3, 4, 5])
def test_closing_in_a_task_equals_the_tables(spark, monkeypatch, k):
    from pointweave.operators import runs

    given = _class_runs(spark, 7, SIDES)
    whole, mixed, tables = _in_tasks_and_by_tables(monkeypatch, lambda: runs.closing_runs(given, k, "w", "h"), SIDES)
    assert whole == mixed == tables and whole


def test_runs_outside_of_the_frame_stay(spark, monkeypatch):
    from pointweave.operators import regions, runs

    rows = [(1, 1, -1, 2, 5), (1, 1, 1, 2, 5), (1, 1, 3, 8, 14), (1, 1, 3, -3, -1), (1, 2, 9, 0, 2), (1, 2, 5, 9, 30), (1, 2, 20, 40, 41)]
    given = spark.createDataFrame(rows, "image_id long, class_id int, y int, x0 int, x1 int")
    for make in (lambda: runs.closing_runs(given, 3, 10, 8), lambda: regions.bridged_regions(given, 5, 10, 8)):
        whole, _, tables = _in_tasks_and_by_tables(monkeypatch, make, [(10, 8), (10, 8)])
        assert whole == tables


@pytest.mark.parametrize("seed, threshold", [(8, 12), (9, 40)])
def test_bridges_in_a_task_equal_the_tables(spark, monkeypatch, seed, threshold):
    from pointweave.operators import regions

    given = _class_runs(spark, seed, SIDES)
    whole, mixed, tables = _in_tasks_and_by_tables(monkeypatch, lambda: regions.bridged_regions(given, threshold, "w", "h"), SIDES)
    plain = sorted(map(tuple, given.select(*_CELLS).collect()))
    assert whole == mixed == tables != plain


def test_a_far_target_outside_of_its_window_draws_nothing(spark, monkeypatch):
    """Beyond some 110 columns the chamfer distance plus five is less than the columns."""
    from pointweave.operators import regions

    rows = [(1, 1, 5, 1, 1)] + [(1, 1, y, 140, 149) for y in range(10)]
    given = spark.createDataFrame(rows, "image_id long, class_id int, y int, x0 int, x1 int")
    whole, _, tables = _in_tasks_and_by_tables(monkeypatch, lambda: regions.bridged_regions(given, 5, 150, 10), [(150, 10), (150, 10)])
    assert whole == tables == sorted(rows)


@pytest.mark.parametrize("name", ["closing_ellipse", "bridged_raster"])
def test_runs_are_not_shuffled_or_written(spark, name):
    """Runs go through their steps in the tasks that make them; only the table of images is written."""
    from pointweave.plans import scratch

    kept, plain = [], scratch.staged
    with pytest.MonkeyPatch.context() as patch:
        for module in ("operators.runs", "operators.regions", "operators.graph"):
            patch.setattr(f"pointweave.{module}.staged", lambda df, name="step": kept.append(name) or plain(df, name))
        found = _exchanges(queries.ALL[name](spark, SF))
    assert not kept and not [e for e in found if "class_id" in e and " y#" in e]


@pytest.mark.parametrize("settings", [(3, 12, 3, 30.0, 3), (4, 30, 0, 60.0, 2), (12, 5, 5, 0.0, 1), (3, 3, 0, 25.0, 1)])
def test_cleanup_in_a_task_equals_the_tables(spark, monkeypatch, settings):
    from pointweave.plans import pipelines

    area, merge, kernel, distance, gap = settings
    given = _class_runs(spark, 11, SIDES)
    pixels = _pictures(spark, 12, SIDES).select("image_id", "y", "x", "b", "g", "r")
    whole, mixed, tables = _in_tasks_and_by_tables(monkeypatch, lambda: pipelines.merged_runs(given, "w", "h", area, merge, kernel, pixels, distance, gap), SIDES)
    assert whole == mixed == tables and whole


def test_like_coloured_neighbours_are_closed_in_a_task(spark, monkeypatch):
    """Two regions of one colour two pixels apart are joined, one of another colour is not."""
    from pointweave.plans import pipelines

    rows = [(1, 1, y, x, x + 7) for y in range(8) for x in (0, 10, 20)]
    given = spark.createDataFrame(rows, "image_id long, class_id int, y int, x0 int, x1 int")
    pixels = spark.createDataFrame([(1, y, x, 200 if x >= 20 else 10, 10, 10) for y in range(8) for x in range(30)], "image_id long, y int, x int, b int, g int, r int")
    whole, _, tables = _in_tasks_and_by_tables(monkeypatch, lambda: pipelines.merged_runs(given, 30, 8, 1, 1, 0, pixels, 30.0, 3), [(30, 8), (30, 8)])
    assert whole == tables == sorted([(1, 1, y, 0, 17) for y in range(8)] + [(1, 1, y, 20, 27) for y in range(8)])


def test_nothing_is_written_for_the_cleanup_of_small_images(spark):
    kept = []
    with pytest.MonkeyPatch.context() as patch:
        for module in ("operators.runs", "operators.regions", "operators.graph", "plans.pipelines"):
            patch.setattr(f"pointweave.{module}.staged", lambda df, name="step": kept.append(name) or df)
        assert queries.ALL["merge_pipeline"](spark, SF).columns == ["image_id", "class_id", "pixels", "places"]
    assert not kept


def test_distances_in_a_task_equal_the_tables(spark, monkeypatch):
    """Images with gaps, with and without places, a place where no pixel is, and one outside."""
    sides = [(33, 37), (21, 50), (20, 20)]
    pixels, draw = _pictures(spark, 13, sides), random.Random(14)
    marks = [(i << 33, draw.randrange(h), draw.randrange(w)) for i, (w, h) in enumerate(sides[:2]) for _ in range(12)] + [(0, 99, 99), (5 << 33, 1, 1)]
    places = spark.createDataFrame(marks, "image_id long, y int, x int")
    found = []
    for tile in (512, 40, 1):
        monkeypatch.setattr(filters, "TILE", tile)
        found.append(sorted(map(tuple, filters.distance_to_places(pixels, places, "w", "h").collect())))
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {0, 1 << 33}


def test_distances_are_not_collected_by_row(spark):
    plan = queries.ALL["edt"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan


def test_superpixels_end_when_nothing_moves(monkeypatch):
    import numpy as np

    draw, calls, sort = np.random.default_rng(15), [], np.lexsort
    monkeypatch.setattr(segments.np, "lexsort", lambda keys: calls.append(1) or sort(keys))
    y, x = (v.ravel() for v in np.mgrid[0:24, 0:30])
    planes = [draw.random(len(y)) * 100 for _ in "bgr"]
    args = (y, x), planes, 6, 5, 20, 400.0
    last = segments._nearest_centres(*args, 400)
    assert len(calls) < 400 and (last == segments._nearest_centres(*args, 800)).all()


def test_nearest_centres_equal_a_search_pixel_by_pixel():
    import numpy as np

    draw = np.random.default_rng(16)
    y, x = np.nonzero(draw.random((17, 26)) < 0.9)
    planes, step, across, cells, weight = [draw.integers(0, 4, len(y)) * 10.0 for _ in "bgr"], 5, 6, 24, 0.7
    found = own = (y // step) * across + x // step + 1
    for rounds in (1, 2, 3):
        values, ids = [*planes, y.astype(float), x.astype(float)], np.unique(found)
        means = np.array([[v[found == i].sum() / (found == i).sum() for v in values] for i in ids])
        next_ = []
        for p in range(len(y)):
            near = [k for k, m in enumerate(means) if abs(m[3] // step - y[p] // step) <= 1 and abs(m[4] // step - x[p] // step) <= 1]
            far = [sum((values[i][p] - means[k][i]) ** 2 for i in range(3)) + weight * sum((values[i][p] - means[k][i]) ** 2 for i in (3, 4)) for k in near]
            next_.append(ids[near[int(np.argmin(far))]] if near else 0)
        found = np.array(next_)
        assert (segments._nearest_centres((y, x), planes, step, across, cells, weight, rounds) == np.where(found > 0, found, own)).all()


def test_report_in_a_task_equals_the_tables(spark, monkeypatch):
    from pointweave.operators import image_runs
    from pointweave.plans import pipelines

    draw = random.Random(17)
    given = _class_runs(spark, 18, [(34, 29), (34, 29)]).drop("w", "h")
    marks = spark.createDataFrame([(i << 33, draw.randrange(29), draw.randrange(34), draw.choice(["C1", "C2", "C3", "C9"])) for i in (0, 1, 4) for _ in range(60)], "image_id long, y int, x int, label string")
    labelset = spark.createDataFrame([(1, "C1", "One"), (2, "C2", None), (3, "C3", "Three")], "class_id int, short_code string, name string")
    found = []
    for most in (256, 1):
        monkeypatch.setattr(image_runs, "SIDE", most)
        out = pipelines.image_report(given, marks, labelset, 34, 29, 4, 12, 3)
        found.append((out.columns, sorted(map(tuple, out.collect()))))
    assert found[0] == found[1] and len(found[0][1]) > 3


@pytest.mark.parametrize("mode, confidence", [("confident", 40.0), ("overwrite", None)])
def test_batch_export_in_a_task_equals_the_tables(spark, monkeypatch, mode, confidence):
    from pointweave.operators import image_runs
    from pointweave.plans import pipelines

    draw, sides = random.Random(19), [(40, 32), (26, 30)]
    images = spark.createDataFrame([(i << 33, f"i{i}.jpg", w, h) for i, (w, h) in enumerate(sides)], "image_id long, image_name string, width int, height int")
    marks = spark.createDataFrame([(f"i{i}.jpg", draw.randrange(h), draw.randrange(w), draw.choice(["C1", "C1", "C2", "C9"]), n) for i, (w, h) in enumerate(sides) for n in range(120)], "image_name string, y int, x int, label string, point_seq long")
    labelset = spark.createDataFrame([(1, "C1", "One"), (2, "C2", None)], "class_id int, short_code string, name string")
    rows = [(i << 33, r, y // b * 100 + x // b, y, x, min(x + b, w) - 1) for i, (w, h) in enumerate(sides) for r, b in enumerate((3, 5, 11)) for y in range(h) for x in range(0, w, b)]
    segments_ = spark.createDataFrame(rows, "image_id long, round int, segment_id long, y int, x0 int, x1 int")
    found = []
    for most in (256, 30, 1):
        monkeypatch.setattr(image_runs, "SIDE", most)
        out = pipelines.batch_export(images, marks, labelset, segments_, None, 28, "majority", mode, 4, 12, 3, confidence)
        found.append([sorted(map(str, out[name].collect())) for name in ("images", "annotations", "summary")])
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 2


@pytest.mark.parametrize("name, written", [("image_report", {"measured"}), ("batch_export", {"runs", "good", "sizes"})])
def test_report_and_export_write_no_steps_of_the_cleanup(spark, name, written):
    from pointweave.plans import scratch

    kept, plain = [], scratch.staged
    with pytest.MonkeyPatch.context() as patch:
        for module in ("operators.runs", "operators.regions", "plans.pipelines"):
            patch.setattr(f"pointweave.{module}.staged", lambda df, name="step": kept.append(name) or plain(df, name))
        queries.ALL[name](spark, SF)
    assert written <= set(kept) <= written | {"blocks", "borders"} and "painted" not in kept
