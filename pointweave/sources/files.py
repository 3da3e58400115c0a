"""Files in and out: point tables, label sets, image folders and pixels, annotation documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pointweave.plans.scratch import staged
from pointweave.sources.split_documents import document_elements

#: Names under which the label column may come; the first that is there counts.
LABEL_COLUMNS = ("Label", "Label code", "label", "label code")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")
DEFAULT_DOCUMENT = "annotations.json"
#: The parts of a document, in its order.
SECTIONS = ("images", "annotations", "categories")

LABELSET_SCHEMA = T.StructType(
    [
        T.StructField("Label ID", T.StringType()),
        T.StructField("Short Code", T.StringType()),
        T.StructField("Color Code", T.ArrayType(T.IntegerType())),
        T.StructField("Color Name", T.StringType()),
        T.StructField("Count", T.IntegerType()),
    ]
)

DOCUMENT_SCHEMA = """
images array<struct<id: bigint, file_name: string, width: int, height: int>>,
annotations array<struct<id: bigint, image_id: bigint, category_id: int, segmentation: array<array<double>>, bbox: array<double>, area: double, iscrowd: int>>,
categories array<struct<id: int, name: string>>"""


def point_columns(table: DataFrame) -> DataFrame:
    """(image_name, row, col, label) of a table with Name, Row, Column and one of the label columns; others are ignored."""
    label = next((c for c in LABEL_COLUMNS if c in table.columns), None)
    missing = [c for c in ("Name", "Row", "Column") if c not in table.columns] + ["Label"] * (label is None)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    extra = ["point_seq"] if "point_seq" in table.columns else []
    number = lambda c: F.col(f"`{c}`").cast("double")
    return table.select(F.col("Name").cast("string").alias("image_name"), number("Row").alias("row"), number("Column").alias("col"), F.col(f"`{label}`").cast("string").alias("label"), *extra)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of CSV files plus point_seq, the order in the file; rows with a null name or place go to rejected_points()."""
    table = spark.read.option("header", True).option("enforceSchema", False).csv(path).withColumn("point_seq", F.monotonically_increasing_id())
    return point_columns(table).dropna(subset=["image_name", "row", "col"])


def rejected_points(spark: SparkSession, path: str) -> DataFrame:
    table = point_columns(spark.read.option("header", True).csv(path))
    return table.filter("image_name is null or row is null or col is null")


def read_labelset(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, short_code, color, color_name, class_id, seq), seq being the order in the file; class ids must be 1 to 255, as 0 is the background."""
    table = spark.read.schema(LABELSET_SCHEMA).option("multiLine", True).json(path)
    out = table.toDF("label_id", "short_code", "color", "color_name", "class_id")
    if out.filter("class_id is null or class_id not between 1 and 255").limit(1).count():
        raise ValueError("class ids must be 1 to 255")
    return out.withColumn("seq", F.monotonically_increasing_id())


def list_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, image_name) of the image files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)).withColumn("image_name", F.regexp_extract("path", r"([^/]+)$", 1))


def read_image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, width, height, y, x, b, g, r) of the images that can be decoded; others are left out.

    Pixel rows leave the decoder a block of image rows at a time. Orientation tags are not applied; see oriented().
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    rows = images.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("image_name"), "image.width", "image.height", "image.nChannels", "image.data")
    lines = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    stride = F.col("width") * F.col("nChannels")
    lines = lines.select("image_name", "width", "height", "nChannels", "y", F.expr("substring(data, cast(y * width * nChannels + 1 as int), cast(width * nChannels as int))").alias("line")).filter(stride > 0)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, width, height, channels, y, line in batch.itertuples(index=False):
                values = np.frombuffer(line, np.uint8).reshape(width, channels)
                b, g, r = (values[:, min(c, channels - 1)] for c in range(3))
                yield pd.DataFrame({"image_name": name, "width": width, "height": height, "y": y, "x": np.arange(width, dtype=np.int32), "b": b.astype(np.int32), "g": g.astype(np.int32), "r": r.astype(np.int32)})

    return lines.mapInPandas(unpack, "image_name string, width int, height int, y int, x int, b int, g int, r int")


def oriented(pixels: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Pixels, width and height as the orientation of their image, 1 to 8 as cameras write it, has them shown.

    1 leaves an image, 2 mirrors it left to right, 3 turns it by half, 4 mirrors it top to bottom, 5 to 8 swap rows and
    columns: 5 about the main diagonal, 6 by a quarter turn clockwise, 7 about the other diagonal, 8 by a quarter turn
    back. Null or any other number leaves the image.
    """
    o, y, x = F.coalesce(F.col(orientation).cast("int"), F.lit(1)), F.col("y"), F.col("x")
    swapped = o.between(5, 8)
    down, right = F.col("height") - 1 - y, F.col("width") - 1 - x
    new_y = F.when(o.isin(3, 4), down).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    new_x = F.when(o.isin(2, 3), right).when(o.isin(5, 8), y).when(o.isin(6, 7), down).otherwise(x)
    sides = {"width": F.when(swapped, F.col("height")).otherwise(F.col("width")), "height": F.when(swapped, F.col("width")).otherwise(F.col("height"))}
    return pixels.withColumns({"y": new_y.cast("int"), "x": new_x.cast("int"), **sides})


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The images, annotations and categories of annotation documents, which are read in splits; see split_documents.

    An element that is no JSON of its section's form raises when it is read; a field that it lacks is null.
    """
    elements = staged(document_elements(spark, path, SECTIONS), "document")
    tables = {field.name: field.dataType.elementType for field in T.StructType.fromDDL(DOCUMENT_SCHEMA)}
    parsed = lambda name: F.from_json("text", tables[name], {"mode": "FAILFAST"})
    return {name: elements.filter(F.col("section") == name).select(parsed(name).alias("r")).select("r.*") for name in SECTIONS}


def document_file(path: str) -> str:
    return path if path.endswith(".json") else f"{path.rstrip('/')}/{DEFAULT_DOCUMENT}"


def write_tables(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """The form for large exports: three Parquet tables."""
    for name, table in (("images", images), ("annotations", annotations), ("categories", categories)):
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


class DocumentSource(DataSource):
    """One JSON document, written by all tasks: rows (section, id, value) come in the document's order, ranged over partitions."""

    @classmethod
    def name(cls) -> str:
        return "annotation_document"

    def schema(self) -> str:
        return "section int, id long, value string"

    def writer(self, schema, overwrite) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["job"])


@dataclass
class Piece(WriterCommitMessage):
    partition: int
    files: dict[int, str]


class DocumentWriter(DataSourceWriter):
    """Tasks write the elements of a section that they hold as a piece; the commit puts header, pieces and footer in order.

    The document appears under its name at the end only; pieces of failed attempts go with the folder of the job.
    """

    def __init__(self, path: str, job: str):
        self.path, self.folder = path, f"{path}.{job}"

    def _at(self, path: str) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, iterator: Iterator) -> Piece:
        context, files, out, section = TaskContext.get(), {}, None, None
        store, folder = self._at(self.folder)
        store.create_dir(folder)
        for row in iterator:
            if row[0] != section:
                if out:
                    out.close()
                section = row[0]
                files[section] = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}-{section}"
                out = store.open_output_stream(files[section])
                out.write(row[2].encode())
            else:
                out.write(b"," + row[2].encode())
        if out:
            out.close()
        return Piece(context.partitionId(), files)

    def commit(self, messages: list[Piece]) -> None:
        store, target = self._at(self.path)
        ready = f"{self._at(self.folder)[1]}/document"
        store.create_dir(ready.rpartition("/")[0])
        with store.open_output_stream(ready) as out:
            for number, name in enumerate(SECTIONS):
                out.write((("{" if not number else ",") + f'"{name}":[').encode())
                pieces = [m.files[number] for m in sorted(messages, key=lambda m: m.partition) if m and number in m.files]
                for k, piece in enumerate(pieces):
                    out.write(b"," if k else b"")
                    with store.open_input_stream(piece) as held:
                        while block := held.read(8 << 20):
                            out.write(block)
                out.write(b"]")
            out.write(b"}")
        kind = store.get_file_info(target).type
        if kind == FileType.Directory:
            store.delete_dir(target)
        elif kind == FileType.File:
            store.delete_file(target)
        store.move(ready, target)
        store.delete_dir(ready.rpartition("/")[0])

    def abort(self, messages: list) -> None:
        store, folder = self._at(self.folder)
        if store.get_file_info(folder).type != FileType.NotFound:
            store.delete_dir(folder)


def write_document(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame, pieces: int | None = None) -> None:
    """One JSON document of any size in one file, its elements in the order of ids; no task holds more than rows of its
    range at a time. The folder is one that driver and executors share, or a store that pyarrow reaches by its address."""
    spark = images.sparkSession
    spark.dataSource.register(DocumentSource)
    rows = None
    for number, table in enumerate((images, annotations, categories)):
        value = F.to_json(F.struct("id", *[c for c in table.columns if c != "id"]))
        part = table.select(F.lit(number).alias("section"), F.col("id").cast("long").alias("id"), value.alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    count = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, "section", "id").sortWithinPartitions("section", "id")
    ranged.write.format("annotation_document").option("path", document_file(path)).option("job", uuid.uuid4().hex).mode("append").save()
