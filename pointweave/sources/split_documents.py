"""Annotation documents of any size read in splits.

A document is one nested JSON value, so no split can tell by itself whether a brace in it opens an element or stands in
a string. The text source cuts the file at closing braces, in splits; quotes before a fragment tell whether it begins in
a string, brackets before it how deep, closed elements before it which element it belongs to. Those three sums run over
fragments inside a split and over one row a split between them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.plans.scratch import small_side, staged

#: Depth of what stands in a section: the document is 1, a section 2, its elements 3.
SECTION_DEPTH = 2
_SPLIT = ["file", "block"]
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[\[\]{}]', re.S)


def _without(text: Column, characters: str) -> Column:
    """How often these characters stand in the text."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text, quotes, outside, inside): what stands between closing braces, in the order of block and seq.

    quotes counts unescaped ones; outside and inside say by how much the depth changes up to and with the closing brace,
    if the fragment begins outside or inside a string.
    """
    read = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
    plain = F.regexp_replace("text", r"(?s)\\.", "")  # no escape goes over a brace
    read = read.withColumn("quotes", _without(plain, '"'))

    def change(begun: Column, closes: int) -> Column:
        bare = F.regexp_replace(begun, r'"[^"]*("|\z)', "")
        return _without(bare, "[{") - _without(bare, "]") - F.when(F.col("quotes") % 2 == closes, 1).otherwise(0)

    return read.withColumns({"outside": change(plain, 0), "inside": change(F.concat(F.lit('"'), plain), 1)})


def summed_before(df: DataFrame, column: str, name: str) -> DataFrame:
    """df, written, with the sum of a column over all fragments before each; one row a split is ordered by file."""
    own = F.sum(column).over(W.partitionBy(*_SPLIT).orderBy("seq")) - F.col(column)
    sums = df.groupBy(*_SPLIT).agg(F.sum(column).alias("_sum"))
    before = sums.select(*_SPLIT, (F.sum("_sum").over(W.partitionBy("file").orderBy("block")) - F.col("_sum")).alias("_before"))
    return staged(df.withColumn(name, own).join(before, _SPLIT).withColumn(name, F.col(name) + F.col("_before")).drop("_before"), name)


def head(text: str, depth: int) -> tuple[str | None, int | None]:
    """The section that begins in front of the first element of a text, None if none does, "" if it is no list; and where that element begins."""
    section = name = None
    for token in _TOKEN.finditer(text):
        kind = token.group()
        if kind in "[{":
            depth += 1
            if depth == SECTION_DEPTH:
                section = name if kind == "[" else ""
            elif depth == SECTION_DEPTH + 1 and kind == "{":
                return section, token.start()
        elif kind in "]}":
            depth -= 1
        elif depth == SECTION_DEPTH - 1:
            name = json.loads(kind)
    return section, None


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [head(text, depth) for text, depth in zip(batch["text"], batch["depth"])]
        cut = [None if at is None else text[at:] for text, (_, at) in zip(batch["text"], found)]
        yield pd.DataFrame({"file": batch["file"], "element": batch["element"], "text": cut, "section": [s for s, _ in found]}, dtype=object)


def document_elements(spark: SparkSession, path: str, sections: tuple[str, ...]) -> DataFrame:
    """(section, file, element, text): the objects in the named lists at the top of each document, numbered in its order.

    A file is read in splits and each element is put together from its fragments in one group, so that only a single
    element has to fit in memory. Elements that are no objects are left out, other names at the top are passed over; a
    name that comes twice gives the elements of both. An empty file gives no rows; one whose brackets or quotes are not
    balanced raises ValueError.
    """
    cut = staged(fragments(spark, path), "fragments")
    narrow = summed_before(cut.select(*_SPLIT, "seq", "quotes", "outside", "inside"), "quotes", "quotes_before")
    change = F.when(F.col("quotes_before") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    deep = summed_before(narrow.select(*_SPLIT, "seq", "quotes", change.alias("change")), "change", "depth")
    ends = deep.groupBy("file").agg(F.sum("change").alias("depth"), (F.sum("quotes") % 2).alias("open"))
    torn = ends.filter("depth not in (-1, 0) or open = 1").select("file").limit(1).collect()  # -1: blanks behind the last brace
    if torn:
        raise ValueError(f"not a whole document: {torn[0]['file']}")
    after = F.col("depth") + F.col("change")
    closed = deep.select(*_SPLIT, "seq", "depth", after.alias("after"), (after <= SECTION_DEPTH).cast("int").alias("closes"))
    placed = summed_before(closed, "closes", "element").drop("closes").join(cut.select(*_SPLIT, "seq", "text"), [*_SPLIT, "seq"])
    inner = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    place = F.struct("block", "seq")
    whole = placed.groupBy("file", "element").agg(F.concat(F.array_join(F.transform(inner, lambda x: x["text"]), "}"), F.lit("}")).alias("text"), F.min_by("depth", place).alias("depth"), F.max_by("after", place).alias("after"))
    whole = staged(whole.filter(F.col("after") == SECTION_DEPTH).drop("after"), "elements")
    plain = (F.col("depth") == SECTION_DEPTH) & F.col("text").rlike(r"^\s*,\s*\{")
    begun = staged(whole.filter(~plain).mapInPandas(_heads, "file string, element long, text string, section string"), "heads")
    follows = F.lead("element").over(W.partitionBy("file").orderBy("element"))  # one row a name at the top
    spans = begun.filter("section is not null").select("file", "section", F.col("element").alias("first"), follows.alias("next")).filter(F.col("section").isin(*sections))
    rows = whole.filter(plain).select("file", "element", F.regexp_replace("text", r"^\s*,\s*", "").alias("text")).unionByName(begun.filter("text is not null").drop("section"))
    spans = small_side(spans.withColumnRenamed("file", "of"), "spans")
    within = (F.col("of") == F.col("file")) & (F.col("element") >= F.col("first")) & (F.col("next").isNull() | (F.col("element") < F.col("next")))
    return rows.join(spans, within).select("section", "file", "element", "text")
