"""Column expressions: names, coordinates, scores, colours, round values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_name(name: str | Column) -> Column:
    """A file name without ' (n)' or '[-_]copy<n>' before a dot, and with a doubled extension once (the last one's case)."""
    name = F.regexp_replace(name, r"\s*\(\d+\)\s*(?=\.)", "")
    name = F.regexp_replace(name, r"(?i)[-_]?copy\d*(?=\.)", "")
    return F.regexp_replace(name, r"(?i)(\.[^./]+)(\1)$", "$2")


def scaled(value: str | Column, factor: float) -> Column:
    """Processing scale: half to even."""
    return F.rint((F.col(value) if isinstance(value, str) else value) * factor).cast("int")


def truncated(value: str | Column, factor: float) -> Column:
    """Pyramid scale and image sizes: towards zero."""
    return ((F.col(value) if isinstance(value, str) else value) * factor).cast("int")


def rescaled(value: Column, factor: float) -> Column:
    """Export coordinates: times the factor, to one decimal, half to even."""
    return F.bround(value * F.lit(float(factor)), 1)


def point_score(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n == 1, 20).when(n == 2, 30).otherwise(F.least(F.lit(40), 30 + 2 * n)).cast("double")


def consistency_score(n: Column, matching: Column) -> Column:
    return F.when(n > 0, 30.0 * matching / n).otherwise(0.0)


def size_score(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.001, 5).when(ratio < 0.005, 15).when(ratio < 0.01, 25).when(ratio < 0.30, 30).when(ratio < 0.50, 20).otherwise(10).cast("double")
    )


def grey(b: Column, g: Column, r: Column) -> Column:
    """Luma of 8-bit channels, rounded to the nearest level."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def _linear(c: Column) -> Column:
    c = c / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def _xyz(b: Column, g: Column, r: Column) -> list[Column]:
    """X, Y and Z of linear channels against white."""
    return [(0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.95047, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.08883]


def _curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)


def _lab(x: Column, y: Column, z: Column) -> Column:
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def lab(b: Column, g: Column, r: Column) -> Column:
    """CIE L*a*b* (D65) of 8-bit sRGB as struct<l, a, b>."""
    return _lab(*[_curve(t) for t in _xyz(_linear(b), _linear(g), _linear(r))])


def with_lab(pixels: DataFrame, name: str = "lab") -> DataFrame:
    """pixels (b, g, r and more) plus lab() of their channels, step by step, so that no power or root is taken twice."""
    out = pixels.withColumns({f"_{c}": _linear(F.col(c)) for c in "bgr"})
    out = out.withColumns(dict(zip(("_tx", "_ty", "_tz"), _xyz(F.col("_b"), F.col("_g"), F.col("_r"))))).drop("_b", "_g", "_r")
    out = out.withColumns({f"_f{c}": _curve(F.col(f"_t{c}")) for c in "xyz"}).drop("_tx", "_ty", "_tz")
    return out.withColumn(name, _lab(F.col("_fx"), F.col("_fy"), F.col("_fz"))).drop("_fx", "_fy", "_fz")


def scaled_round_value(kind: Column, value: Column, scale: Column) -> Column:
    """A round's parameter for an image at a scale: superpixel counts by area, graph scales against length."""
    return F.when(kind == "superpixel", value * scale * scale).when(kind == "graph", value / F.sqrt(scale)).otherwise(value)


def unscaled_round_value(kind: Column, value: Column, scale: Column) -> Column:
    return F.when(kind == "superpixel", value / (scale * scale)).when(kind == "graph", value * F.sqrt(scale)).otherwise(value)


def snapped(value: Column, options: Column) -> Column:
    """The closest of an array of options; the first of equally close ones."""
    ranked = F.transform(options, lambda o, i: F.struct(F.abs(o - value).alias("far"), i.alias("at"), o.alias("option")))
    return F.array_min(ranked)["option"]
