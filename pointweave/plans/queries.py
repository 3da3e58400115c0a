"""Registered queries of the raster operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.scalars import consistency_score, grey, normalized_name, point_score, rescaled, scaled, size_score, truncated, unscaled_round_value, with_lab
from pointweave.operators import annotations, filters, names, points, regions, runs, segments, votes
from pointweave.plans import pipelines
from pointweave.plans.scratch import scratch_path
from pointweave.sources import files
from pointweave.sources.derived import view
from pointweave.streaming.incremental import export_new_images

WIDTH, HEIGHT = 128, 96
PIXELS = WIDTH * HEIGHT

#: Settings of rounds and the values that each kind allows.
ROUNDS = [(0, "superpixel", 3000.0), (1, "superpixel", 900.0), (2, "graph", 300.0), (3, "adaptive", 10.0)]
OPTIONS = [("superpixel", [30.0, 100.0, 300.0, 900.0, 1500.0, 3000.0]), ("graph", [100.0, 300.0, 500.0, 1000.0]), ("adaptive", [5.0, 10.0, 20.0])]


def _points(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "points")


def _inside(spark: SparkSession, d: str) -> DataFrame:
    return points.in_bounds(_points(spark, d), WIDTH, HEIGHT)


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Points by round and segment; segments are runs."""
    return votes.point_segments(points.labelled(_inside(spark, d), view(spark, d, "labelset")), view(spark, d, "segment_runs"))


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """Labelled runs of all rounds."""
    return votes.painted(view(spark, d, "segment_runs"), votes.majority_votes(_located(spark, d)))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Class runs of the first round."""
    first = view(spark, d, "segment_runs").filter("round = 0")
    located = votes.point_segments(points.labelled(_inside(spark, d), view(spark, d, "labelset")), first)
    return runs.merged_runs(votes.painted(first, votes.majority_votes(located)).select("image_id", "class_id", "y", "x0", "x1"), ["image_id", "class_id", "y"])


def _labelled(spark: SparkSession, d: str, connectivity: int = 8) -> DataFrame:
    return regions.labelled_runs(_runs(spark, d), connectivity)


def _image_seq(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "images").select("image_name", F.col("image_id").alias("seq"))


def _name_seq(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).groupBy(F.col("image_name").alias("annotation_name")).agg(F.min("image_id").alias("seq"))


def _file_names(spark: SparkSession, d: str) -> DataFrame:
    """Every part's name as a file name with the suffixes that people's files carry."""
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.concat(
            F.regexp_replace("p_name", " ", "_"),
            F.element_at(F.array(*[F.lit(s) for s in (".jpg", ".jpeg.jpeg", ".JPG.jpg", " (1).jpg", "_copy2.png", "-Copy.png", "photocopy.jpg", " (12).jpg.jpg", "", ".jpg.jpg.jpg")]), (F.col("p_partkey") % 10 + 1).cast("int")),
        ).alias("name"),
    )


def normalize_names(spark, d):
    return _file_names(spark, d).select("id", "name", normalized_name("name").alias("normalized"))


def match_batch(spark, d):
    return names.match_batch(view(spark, d, "images"), _name_seq(spark, d))


def match_app(spark, d):
    return names.match_app(_image_seq(spark, d), _name_seq(spark, d))


def images_without_points(spark, d):
    return names.images_without_points(view(spark, d, "images"), match_batch(spark, d))


def points_without_images(spark, d):
    return names.points_without_images(_name_seq(spark, d), match_batch(spark, d))


def resume_remaining(spark, d):
    """Images not yet in an export that holds the names of all suppliers with a balance of 5000 or more."""
    done = view(spark, d, "images").join(spark.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal >= 5000").select(F.col("s_suppkey").cast("long").alias("image_id")), "image_id")
    return names.not_yet_exported(view(spark, d, "images"), done.select(F.col("image_name").alias("file_name"))).select("image_id", "image_name")


def resolve_paths(spark, d):
    listing = view(spark, d, "images").select(F.concat(F.lit("/data/"), F.col("height").cast("string"), F.lit("/"), F.col("image_name")).alias("path"))
    return names.resolve_paths(_points(spark, d), listing)


def match_report(spark, d):
    images, found = _image_seq(spark, d), match_app(spark, d)
    one = [
        images.agg(F.count("*").alias("images")),
        _name_seq(spark, d).agg(F.count("*").alias("annotated")),
        found.agg(F.count("*").alias("matched"), F.sum((F.col("image_name") != F.col("annotation_name")).cast("long")).alias("by_normal_form")),
        names.search_names(images, "9.j").agg(F.count("*").alias("found")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # single rows
    return out


def top_images(spark, d):
    return names.top_images(_points(spark, d), 100)


def scale_points(spark, d):
    return _points(spark, d).select("image_id", "point_seq", scaled("y", 0.5).alias("y"), scaled("x", 0.5).alias("x"))


def pyramid_points(spark, d):
    return _points(spark, d).select("image_id", "point_seq", truncated("y", 0.5).alias("y"), truncated("x", 0.25).alias("x"), truncated(F.lit(WIDTH), 0.25).alias("width"))


def in_bounds(spark, d):
    return points.labelled(_inside(spark, d), view(spark, d, "labelset")).select("image_id", "point_seq", "y", "x", "class_id")


def quality_reasons(spark, d):
    return points.quality_reasons(view(spark, d, "part_points"), least_points=28)


def quality_summary(spark, d):
    return quality_reasons(spark, d).groupBy("reason").agg(F.count("*").alias("images"), F.sum("points").alias("points"))


def enrich_labels(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    labelset = nations.select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("short_code"), F.when(F.col("n_regionkey") > 2, F.lower("n_name")).alias("name"), F.lit(None).cast("string").alias("functional_group"))
    meta = nations.join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_regionkey < 2")
    meta = meta.select(F.col("n_name").alias("short_code"), F.concat("n_name", F.lit(" reef")).alias("name"), F.col("r_name").alias("functional_group"))
    return points.enriched_labels(labelset, meta).select("class_id", "short_code", "name", "functional_group")


def param_table(spark, d):
    images = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("image_id"), F.when(F.col("s_acctbal") < 0, 0.25).when(F.col("s_acctbal") < 5000, 0.5).otherwise(1.0).alias("scale"))
    return points.round_parameters(images, spark.createDataFrame(ROUNDS, "round int, kind string, value double"), spark.createDataFrame(OPTIONS, "kind string, options array<double>"))


def unscaled_params(spark, d):
    rounds = spark.createDataFrame(ROUNDS, "round int, kind string, value double")
    images = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("image_id"), F.when(F.col("s_acctbal") < 0, 0.25).otherwise(0.5).alias("scale"))
    return images.crossJoin(F.broadcast(rounds)).select("image_id", "round", F.round(unscaled_round_value(F.col("kind"), F.col("value"), F.col("scale")), 6).alias("value"))  # four rounds an image


def vote_majority(spark, d):
    return votes.majority_votes(_located(spark, d))


def vote_last_write(spark, d):
    return votes.last_votes(_located(spark, d))


def fold_fill(spark, d):
    return votes.fold_runs(_rounds(spark, d), "fill").groupBy("image_id", "class_id").agg(*runs.run_sums())


def fold_overwrite(spark, d):
    return votes.fold_runs(_rounds(spark, d), "overwrite").groupBy("image_id", "class_id").agg(*runs.run_sums())


def fold_confident(spark, d):
    return votes.fold_runs(_rounds(spark, d), "confident", 3).groupBy("image_id", "class_id").agg(*runs.run_sums())


def round_coverage(spark, d):
    return votes.round_coverage(_rounds(spark, d), PIXELS).withColumn("coverage", F.round("coverage", 6))


def class_histogram(spark, d):
    found = votes.class_histogram(votes.fold_runs(_rounds(spark, d), "fill")).withColumn("share", F.round("share", 6))
    return found.join(F.broadcast(view(spark, d, "labelset").select("class_id", "name")), "class_id").select("image_id", "class_id", "name", "pixels", "share")


def point_histogram(spark, d):
    return votes.label_histogram(_points(spark, d)).withColumn("share", F.round("share", 6))


def annotation_counts(spark, d):
    per = _points(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("most"), F.min("n").alias("fewest"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("images"))


def distinct_classes(spark, d):
    found = votes.fold_runs(_rounds(spark, d), "overwrite")
    return found.groupBy("image_id").agg(F.count_distinct("class_id").alias("classes"), F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("pixels"))


def runs_encode(spark, d):
    return _runs(spark, d)


def resample_nearest(spark, d):
    small = runs.resampled_runs(_runs(spark, d), (WIDTH, HEIGHT), (51, 38))
    return runs.resampled_runs(small, (51, 38), (WIDTH, HEIGHT)).groupBy("image_id", "class_id").agg(*runs.run_sums())


def resample_bilinear(spark, d):
    out = runs.resample_bilinear(view(spark, d, "pixels").select("image_id", "y", "x", F.col("b").cast("double").alias("v")), (WIDTH, HEIGHT), (51, 38))
    return out.groupBy("image_id", "y").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


def colour_planes(spark, d):
    p = with_lab(view(spark, d, "pixels")).select("image_id", grey(*[F.col(c) for c in "bgr"]).alias("grey"), "lab")
    return p.groupBy("image_id").agg(F.sum("grey").alias("grey"), *[F.round(F.avg(f"lab.{c}"), 4).alias(c) for c in ("l", "a", "b")])


def closing_ellipse(spark, d):
    return runs.closing_runs(_runs(spark, d), 5, WIDTH, HEIGHT).groupBy("image_id", "class_id").agg(*runs.run_sums())


def components8(spark, d):
    return regions.region_measures(_labelled(spark, d, 8)).drop("region_id")


def components4(spark, d):
    return regions.region_measures(_labelled(spark, d, 4)).drop("region_id")


def count_segments_rollup(spark, d):
    return regions.segment_counts(_labelled(spark, d, 8))


def speckle_removal(spark, d):
    kept = regions.without_speckles(_runs(spark, d), 40)
    return kept.groupBy("image_id", "class_id").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("pixels"), F.count("*").alias("runs"))


def merge_compare(spark, d):
    """Regions by class before and after small ones go, zero-filled."""
    labelled = _labelled(spark, d, 8)
    before = regions.segment_counts(labelled).filter("class_id is not null")
    after = regions.region_measures(labelled).filter("area >= 40").groupBy("image_id", "class_id").agg(F.count("*").alias("after"))
    return before.join(after, ["image_id", "class_id"], "left").select("image_id", "class_id", F.col("regions").alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.col("regions") - F.coalesce("after", F.lit(0))).alias("gone"))


def merge_classes(spark, d):
    """Classes of an image before and after small regions go."""
    labelled = _labelled(spark, d, 8)
    classes = F.count_distinct("class_id")
    after = regions.region_measures(labelled).filter("area >= 150").groupBy("image_id").agg(classes.alias("after"))
    return labelled.groupBy("image_id").agg(classes.alias("before")).join(after, "image_id", "left").fillna(0, ["after"])


def region_colours(spark, d):
    labelled = _labelled(spark, d, 8)
    mean = regions.region_colours(labelled, view(spark, d, "pixels"))
    place = regions.region_measures(labelled).select(*regions.REGION, "class_id", "bbox_x", "bbox_y", "area")
    return mean.join(place, regions.REGION).select("image_id", "class_id", "bbox_x", "bbox_y", "area", *[F.round(c, 4).alias(c) for c in "bgr"])


def region_adjacency(spark, d):
    labelled = _labelled(spark, d, 8)
    pairs = regions.region_adjacency(labelled)
    return pairs.groupBy("image_id").agg(F.count("*").alias("pairs"))


def colour_merge_identity(spark, d):
    """Groups of like-coloured touching regions of a class: with a gap of one every region is its own group."""
    return _colour_groups(spark, d, 30.0, 1)


def colour_merge_gap(spark, d):
    """Groups of like-coloured regions of a class that lie up to three pixels apart."""
    return _colour_groups(spark, d, 12.0, 3)


def _colour_groups(spark: SparkSession, d: str, distance: float, gap: int) -> DataFrame:
    labelled = _labelled(spark, d, 8)
    groups = regions.colour_groups(labelled, regions.region_colours(labelled, view(spark, d, "pixels")), distance, gap)
    return groups.groupBy("image_id").agg(F.count("*").alias("regions"), F.count_distinct("group_id").alias("groups"))


def bridge_targets(spark, d):
    return regions.bridge_targets(_labelled(spark, d, 8), 48).drop("region_id")


def region_confidence(spark, d):
    lookup = points.class_lookup(view(spark, d, "labelset"))
    out = regions.region_confidence(_runs(spark, d), _inside(spark, d), lookup, PIXELS).drop("region_id")
    return out.withColumns({c: F.round(c, 6) for c in ("size_ratio", "consistency_score", "confidence")})


def confidence_summary(spark, d):
    return regions.confidence_summary(region_confidence(spark, d)).withColumn("mean", F.round("mean", 4))


def confidence_filter(spark, d):
    lookup = points.class_lookup(view(spark, d, "labelset"))
    labelled = _labelled(spark, d, 4)
    scored = regions.labelled_confidence(labelled, _inside(spark, d), lookup, PIXELS)
    return regions.confident_runs(labelled, scored, 70.0).groupBy("image_id", "class_id").agg(runs.run_sums()[0])


def score_tables(spark, d):
    """The three scores over the counts and sizes that orders have."""
    o = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_linenumber") < 3, 1).otherwise(0)).alias("m"), F.max("l_discount").alias("q"))
    ratio = F.col("q").cast("double") * 6
    return o.select(F.col("l_orderkey").alias("id"), point_score(F.col("n")).alias("points"), F.round(consistency_score(F.col("n"), F.col("m")), 6).alias("consistency"), size_score(ratio).alias("size"))


def coco_images(spark, d):
    return annotations.coco_images(view(spark, d, "images"))


def coco_categories(spark, d):
    """Categories of a label set of one entry a nation, of which some have no name of their own."""
    nations = spark.read.parquet(f"{d}/nation.parquet")
    return annotations.coco_categories(nations.select((F.col("n_nationkey") + 1).cast("int").alias("class_id"), F.col("n_name").alias("short_code"), F.when(F.col("n_regionkey") > 1, F.lower("n_name")).alias("name")))


def coco_annotations(spark, d):
    out = annotations.coco_annotations(_labelled(spark, d, 8), 0.4)
    return out.select("id", "image_id", "category_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("bbox_x", "bbox_y", "bbox_w", "bbox_h"))], "area", "iscrowd")


def boundary_polygons(spark, d):
    return annotations.boundary_polygons(_labelled(spark, d, 8)).drop("region_id")


def resume_ids(spark, d):
    labelled = _labelled(spark, d, 8)
    images = annotations.coco_images(view(spark, d, "images"))
    return annotations.next_ids(annotations.coco_annotations(labelled), images)


def run_report(spark, d):
    labelled = _labelled(spark, d, 8)
    return annotations.run_report(annotations.coco_images(view(spark, d, "images")), annotations.coco_annotations(labelled), annotations.coco_categories(view(spark, d, "labelset")))


def number_images(spark, d):
    return names.numbered(view(spark, d, "images").select("image_name"), ["image_name"], "id", after=10)


def export_coordinates(spark, d):
    return _points(spark, d).select("image_id", "point_seq", rescaled(F.col("y").cast("double"), 2.5).alias("y"), rescaled(F.col("x").cast("double"), 5.0).alias("x"))


def label_lookup(spark, d):
    """The class of every short code, where several nations share one: the last entry's."""
    entries = spark.read.parquet(f"{d}/nation.parquet").select(F.substring("n_name", 1, 1).alias("short_code"), (F.col("n_nationkey") + 1).cast("int").alias("class_id"), (F.col("n_nationkey") * 7 % 25).alias("seq"))
    return points.class_lookup(entries)


def search_images(spark, d):
    """The first 100 image names, by name, that contain a text."""
    return names.first_names(names.search_names(view(spark, d, "images"), "5.J"))


def normal_form_examples(spark, d):
    return names.normal_form_examples(match_batch(spark, d))


def failed_examples(spark, d):
    """The first ten images, by name, that match points but are not in an export of the suppliers with a balance of 5000 or more."""
    done = view(spark, d, "images").join(spark.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal >= 5000").select(F.col("s_suppkey").cast("long").alias("image_id")), "image_id")
    return names.failed_examples(match_batch(spark, d), done.select(F.col("image_name").alias("file_name")))


def ranked_classes(spark, d):
    return votes.ranked_classes(_runs(spark, d), view(spark, d, "labelset")).withColumn("share", F.round("share", 6))


def appended_export(spark, d):
    """An export of the suppliers with a balance of 5000 or more, continued by all other images."""
    images, labelled = view(spark, d, "images"), _labelled(spark, d, 8)
    done = images.join(spark.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal >= 5000").select(F.col("s_suppkey").cast("long").alias("image_id")), "image_id")
    made = annotations.coco_annotations(labelled.join(done.select("image_id"), "image_id", "left_semi"), 0.4)
    existing = {"images": annotations.coco_images(done), "annotations": made, "categories": annotations.coco_categories(view(spark, d, "labelset"))}
    out = annotations.appended(existing, labelled, images, 0.4)
    per = out["annotations"].groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("annotations"), F.min("id").alias("first"), F.max("id").alias("last"), F.round(F.sum("area"), 1).alias("area"))
    return out["images"].select("id", "file_name").join(per, "id", "left")


def export_summary(spark, d):
    """Matches and what an export of the suppliers with a balance of 5000 or more has done of them."""
    images = view(spark, d, "images")
    done = images.join(spark.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal >= 5000").select(F.col("s_suppkey").cast("long").alias("image_id")), "image_id")
    return annotations.export_summary(images, match_batch(spark, d), done.select(F.col("image_name").alias("file_name")))


def density_map(spark, d):
    out = filters.point_density(_inside(spark, d), WIDTH, HEIGHT)
    return out.groupBy("image_id").agg(F.count("*").alias("pixels"), F.round(F.sum("density"), 4).alias("total"), F.round(F.max(F.when((F.col("y") == 40) & (F.col("x") == 60), F.col("density"))), 6).alias("middle"))


def edt(spark, d):
    """Distances of all pixels to the nearest point of their image."""
    found = filters.distance_to_places(view(spark, d, "pixels").select("image_id", "y", "x"), _inside(spark, d), WIDTH, HEIGHT)
    return found.groupBy("image_id").agg(F.count("*").alias("pixels"), F.round(F.sum("distance"), 4).alias("total"), F.round(F.max("distance"), 6).alias("farthest"))


def _segment_sizes(found: DataFrame) -> DataFrame:
    """Segments an image, their pixels and the largest one's, from runs."""
    sizes = found.groupBy("image_id", "segment_id").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("n"))
    return sizes.groupBy("image_id").agg(F.count("*").alias("segments"), F.sum("n").alias("pixels"), F.max("n").alias("largest"))


def slic_segments(spark, d):
    return _segment_sizes(segments.superpixel_runs(view(spark, d, "pixels"), 100, WIDTH, HEIGHT))


def graph_segments(spark, d):
    return _segment_sizes(segments.graph_segment_runs(view(spark, d, "pixels"), 100.0, WIDTH, HEIGHT))


def watershed_segments(spark, d):
    return _segment_sizes(segments.adaptive_segment_runs(view(spark, d, "pixels"), points.labelled(_inside(spark, d), view(spark, d, "labelset")), WIDTH, HEIGHT))


def merge_pipeline(spark, d):
    merged = pipelines.merged_runs(_runs(spark, d), WIDTH, HEIGHT, 20, 48, 5, view(spark, d, "pixels"), 60.0, 3)
    return merged.groupBy("image_id", "class_id").agg(*runs.run_sums())


def bridged_raster(spark, d):
    return regions.bridged_regions(_runs(spark, d), 48, WIDTH, HEIGHT).groupBy("image_id", "class_id").agg(*runs.run_sums())


def image_report(spark, d):
    return pipelines.image_report(_runs(spark, d), _inside(spark, d), view(spark, d, "labelset"), WIDTH, HEIGHT, 20, 48, 0)


def batch_export(spark, d):
    """Annotations of the whole batch, image by image."""
    out = pipelines.batch_export(view(spark, d, "images"), _points(spark, d), view(spark, d, "labelset"), view(spark, d, "segment_runs"), None, 28, "majority", "confident", 20, 48, 5, 40.0)
    per = out["annotations"].groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("annotations"), F.min("id").alias("first"), F.round(F.sum("area"), 1).alias("area"))
    return out["images"].join(per, "id", "left")


def points_csv(spark, d):
    """All points through CSV files with spare columns, in which every seventh image's rows have lost their place."""
    lost = F.when(F.col("image_id") % 7 != 0, F.col("y"))
    path = scratch_path(spark, "points")
    _points(spark, d).select(F.col("image_name").alias("Name"), lost.alias("Row"), (F.col("x") + 0.5).alias("Column"), F.col("label").alias("Label code"), F.col("image_id").alias("Extra")).write.option("header", True).csv(path)
    return files.read_points(spark, path).select("image_name", "row", "col", "label")


def labelset_json(spark, d):
    """A label set of one entry a nation through its JSON file."""
    path = scratch_path(spark, "labelset")
    number = F.col("n_nationkey")
    entry = F.struct(number.cast("string").alias("Label ID"), F.col("n_name").alias("Short Code"), F.array(*[(number * k % 256).cast("int") for k in (7, 40, 91)]).alias("Color Code"), F.lower("n_name").alias("Color Name"), (number + 1).cast("int").alias("Count"))
    spark.read.parquet(f"{d}/nation.parquet").agg(F.to_json(F.collect_list(entry))).write.text(path)  # a label set has at most 255 entries
    out = files.read_labelset(spark, path)
    return out.select("label_id", "short_code", *[F.col("color")[i].alias(c) for i, c in enumerate(("cr", "cg", "cb"))], "color_name", "class_id")


def document_read_back(spark, d):
    """The whole export as one JSON document, read in splits: every annotation with its image's and class's name."""
    path = f"{scratch_path(spark, 'export')}.json"
    made = annotations.coco_annotations(_labelled(spark, d, 8), 0.4)
    files.write_document(path, annotations.coco_images(view(spark, d, "images")), made, annotations.coco_categories(view(spark, d, "labelset")))
    back = files.read_document(spark, path)
    images = back["images"].select(F.col("id").alias("image_id"), "file_name", "width")
    out = back["annotations"].join(images, "image_id", "left").join(F.broadcast(back["categories"].select(F.col("id").alias("category_id"), "name")), "category_id")  # at most 255 classes
    return out.select("id", "image_id", "file_name", "width", "name", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("bbox_x", "bbox_y", "bbox_w", "bbox_h"))], "area")


def incremental_export(spark, d):
    """All images, with their points, through a stream in two arrivals, the second of which repeats a part of the first:
    the number of every image, how many annotations it has and their first and last number."""
    source, target, log = (scratch_path(spark, name) for name in ("arrivals", "exported", "log"))
    images, marks = view(spark, d, "images").select("image_id", "image_name"), _points(spark, d).select("image_id", "y", "x", "label")
    annotate = lambda fresh: fresh.select("image_id", "image_name").join(marks, "image_id").drop("image_id")
    for arrived in ("image_id % 3 <> 0", "image_id % 3 = 0 or image_id % 2 = 0"):
        images.filter(arrived).write.mode("append").json(source)
        export_new_images(spark, spark.readStream.schema(images.schema).json(source), target, log, annotate).awaitTermination()
    made = spark.read.parquet(f"{target}/annotations").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    out = spark.read.parquet(f"{target}/images").select("id", "file_name").join(made, "id", "left")
    return out.select("id", "file_name", F.coalesce("n", F.lit(0)).alias("annotations"), "first", "last")


ALL = {
    f.__name__: f
    for f in (
        normalize_names, match_batch, match_app, images_without_points, points_without_images, resume_remaining, resolve_paths, match_report, top_images, scale_points, pyramid_points, in_bounds, quality_reasons, quality_summary,
        enrich_labels, param_table, unscaled_params, vote_majority, vote_last_write, fold_fill, fold_overwrite, fold_confident, round_coverage, class_histogram, point_histogram, annotation_counts, distinct_classes, runs_encode,
        resample_nearest, resample_bilinear, colour_planes, closing_ellipse, components8, components4, count_segments_rollup, speckle_removal, merge_compare, merge_classes, region_colours, region_adjacency, colour_merge_identity, colour_merge_gap, bridge_targets,
        region_confidence, confidence_summary, confidence_filter, score_tables, coco_images, coco_categories, coco_annotations, boundary_polygons, resume_ids, run_report, number_images, export_coordinates,
        label_lookup, search_images, normal_form_examples, failed_examples, ranked_classes, appended_export, export_summary, density_map, edt, slic_segments, graph_segments, watershed_segments, merge_pipeline, bridged_raster,
        image_report, batch_export, points_csv, labelset_json, document_read_back, incremental_export,
    )
}
