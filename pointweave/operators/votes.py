"""Labels of segments by the points in them, and rounds folded to one raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.runs import encode_runs, merged_runs, overlay


def segment_runs(segments: DataFrame) -> DataFrame:
    """(image_id, round, segment_id, y, x0, x1) of segments by pixel."""
    return encode_runs(segments, ("image_id", "round", "segment_id"))


def point_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points with the round and segment that they lie in; segments are runs, or pixels."""
    if "x0" in segments.columns:
        return points.join(segments, ["image_id", "y"]).filter("x between x0 and x1").drop("x0", "x1")
    return points.join(segments, ["image_id", "y", "x"])


def majority_votes(located: DataFrame) -> DataFrame:
    """(image_id, round, segment_id, class_id, votes): the most frequent class, ties to the class seen first; votes up to 255."""
    keys = ["image_id", "round", "segment_id"]
    counts = located.groupBy(*keys, "class_id").agg(F.count("*").alias("n"), F.min("point_seq").alias("first"))
    return counts.groupBy(*keys).agg(F.max_by("class_id", F.struct("n", -F.col("first"))).alias("class_id"), F.least(F.sum("n"), F.lit(255)).alias("votes"))


def last_votes(located: DataFrame) -> DataFrame:
    """(image_id, round, segment_id, class_id): the class of the last point."""
    return located.groupBy("image_id", "round", "segment_id").agg(F.max_by("class_id", "point_seq").alias("class_id"))


def painted(segments: DataFrame, votes: DataFrame) -> DataFrame:
    """Runs, or pixels, of labelled segments, round by round."""
    return segments.join(votes, ["image_id", "round", "segment_id"])


#: Bits of a class id, and a number above that of any round.
_CLASS_BITS, _ROUNDS = 16, 1 << 20


def fold_order(mode: str, least_votes: int):
    """The number whose greatest wins a pixel in a fold; its lowest bits are the class."""
    number = F.col("round").cast("long")
    if mode == "fill":
        order = -number
    elif mode == "overwrite":
        order = number
    elif mode == "confident":
        order = F.when(F.col("votes") >= least_votes, number + _ROUNDS).otherwise(-number)
    else:
        raise ValueError(f"unknown fold: {mode}")
    return F.shiftleft(order, _CLASS_BITS) + F.col("class_id")


def _best(mode: str, least_votes: int):
    """The class that a fold gives a pixel, as an aggregate."""
    best = F.max(fold_order(mode, least_votes))  # one number, so that the aggregate hashes
    return best.bitwiseAND(F.lit((1 << _CLASS_BITS) - 1)).cast("int").alias("class_id")


def fold_runs(rounds: DataFrame, mode: str = "fill", least_votes: int = 3) -> DataFrame:
    """Runs (image_id, class_id, y, x0, x1) of one class a pixel from the labelled runs of all rounds; modes as in fold()."""
    return merged_runs(overlay(rounds, _best(mode, least_votes)), ["image_id", "class_id", "y"])


def fold(rounds: DataFrame, mode: str = "fill", least_votes: int = 3) -> DataFrame:
    """One class a pixel from a raster a round (image_id, round, y, x, class_id, and votes for 'confident').

    Class ids are below 65536. fill: the first round with a label; overwrite: the last; confident: the last with enough votes, else the first.
    """
    return rounds.groupBy("image_id", "y", "x").agg(_best(mode, least_votes))


def round_coverage(rounds: DataFrame, pixels_per_image: int) -> DataFrame:
    """(image_id, round, coverage): percent of pixels labelled up to each round that labels any pixel first; rounds are labelled runs."""
    first = overlay(rounds, F.min("round").alias("round"))
    new = first.groupBy("image_id", "round").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    total = F.sum("n").over(W.partitionBy("image_id").orderBy("round"))
    return new.select("image_id", "round", (total * 100.0 / pixels_per_image).alias("coverage"))


def class_histogram(raster_runs: DataFrame) -> DataFrame:
    """(image_id, class_id, pixels, share): pixels by class, percent of the image's labelled pixels; from class runs."""
    counts = raster_runs.groupBy("image_id", "class_id").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("pixels"))
    return counts.withColumn("share", F.col("pixels") * 100.0 / F.sum("pixels").over(W.partitionBy("image_id")))


def ranked_classes(raster_runs: DataFrame, labelset: DataFrame) -> DataFrame:
    """(image_id, rank, class_id, name, pixels, share): an image's classes from the most pixels on, ties in the label set's order."""
    named = class_histogram(raster_runs).join(F.broadcast(labelset.select("class_id", F.coalesce("name", "short_code").alias("name"))), "class_id")
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("pixels"), "class_id"))
    return named.select("image_id", rank.alias("rank"), "class_id", "name", "pixels", "share")


def label_histogram(points: DataFrame) -> DataFrame:
    """(image_id, label, points, share): points by label, percent of the image's points."""
    counts = points.groupBy("image_id", "label").agg(F.count("*").alias("points"))
    return counts.withColumn("share", F.col("points") * 100.0 / F.sum("points").over(W.partitionBy("image_id")))


def coverage(raster_runs: DataFrame, pixels_per_image) -> DataFrame:
    """(image_id, coverage): labelled pixels in percent of all, which are a number or a column."""
    return raster_runs.groupBy("image_id", *([pixels_per_image] if isinstance(pixels_per_image, str) else [])).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n")).select("image_id", (F.col("_n") * 100.0 / (F.col(pixels_per_image) if isinstance(pixels_per_image, str) else F.lit(pixels_per_image))).alias("coverage"))
