import json
import struct
import zlib

import pytest

from pointweave.sources import files, split_documents
from pointweave.streaming.incremental import export_new_images
from pyspark.sql import functions as F


def png(width, height, colour):
    raw = b"".join(b"\x00" + b"".join(bytes(colour(y, x)) for x in range(width)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_points_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Name,Row,Column,Label code,label,Extra\na.jpg,1,2.5,L1,x,9\n,3,4,L2,x,9\nb.jpg,,4,L2,x,9\n")
    rows = files.read_points(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["image_name"], r["row"], r["col"], r["label"]) for r in rows] == [("a.jpg", 1.0, 2.5, "L1")]
    assert files.rejected_points(spark, str(tmp_path / "p.csv")).count() == 2
    (tmp_path / "q.csv").write_text("Name,Row,Label\na,1,b\n")
    with pytest.raises(ValueError, match="Column"):
        files.read_points(spark, str(tmp_path / "q.csv"))


def test_labelset(spark, tmp_path):
    entry = {"Label ID": "1", "Short Code": "A", "Color Code": [1, 2, 3], "Color Name": "c", "Count": 1}
    (tmp_path / "l.json").write_text(json.dumps([entry], indent=1))
    assert tuple(files.read_labelset(spark, str(tmp_path / "l.json")).first()) == ("1", "A", [1, 2, 3], "c", 1, 0)
    (tmp_path / "m.json").write_text(json.dumps([entry | {"Count": 0}]))
    with pytest.raises(ValueError):
        files.read_labelset(spark, str(tmp_path / "m.json"))


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(png(3, 2, lambda y, x: (x, y, 7)))
    (tmp_path / "sub/b.png").write_bytes(png(1, 1, lambda y, x: (1, 2, 3)))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    assert sorted(r["image_name"] for r in files.list_images(spark, str(tmp_path)).collect()) == ["a.PNG", "bad.png"]
    assert files.list_images(spark, str(tmp_path), recursive=True).count() == 3
    got = {(r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in files.read_image_pixels(spark, str(tmp_path / "*.*")).collect()}
    assert got == {(y, x): (7, y, x) for y in range(2) for x in range(3)}


def test_document_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", 4, 3)], "id long, file_name string, width int, height int")
    marks = spark.createDataFrame([(1, 1, 2, [[0.0, 0.0, 3.0, 0.0, 3.0, 2.0]], [0.0, 0.0, 4.0, 3.0], 12.0, 0)], "id long, image_id long, category_id int, segmentation array<array<double>>, bbox array<double>, area double, iscrowd int")
    categories = spark.createDataFrame([(2, "x")], "id int, name string")
    files.write_document(str(tmp_path / "out"), images, marks, categories)
    back = files.read_document(spark, files.document_file(str(tmp_path / "out")))
    assert back["images"].collect() == images.collect() and back["annotations"].collect() == marks.collect() and back["categories"].collect() == categories.collect()
    files.write_tables(str(tmp_path / "tables"), images, marks, categories)
    assert spark.read.parquet(str(tmp_path / "tables/annotations")).collect() == marks.collect()


def test_incremental_export_in_two_drops_equals_one(spark, tmp_path):
    def run(target, drops):
        source, out = tmp_path / f"{target}-in", str(tmp_path / target)
        for i, drop in enumerate(drops):
            spark.createDataFrame([(n,) for n in drop], "image_name string").coalesce(1).write.mode("append").json(str(source))
            stream = spark.readStream.schema("image_name string").option("maxFilesPerTrigger", 1).json(str(source))
            annotate = lambda df: df.select("image_name", F.explode(F.sequence(F.lit(1), F.length("image_name"))).alias("category_id"))
            export_new_images(spark, stream, out, str(tmp_path / f"{target}-log"), annotate).awaitTermination()
        images = spark.read.parquet(f"{out}/images").select("id", "file_name")
        marks = spark.read.parquet(f"{out}/annotations")
        assert sorted(r["id"] for r in marks.collect()) == list(range(1, marks.count() + 1))
        named = marks.join(images.withColumnRenamed("id", "image_id"), "image_id").select("file_name", "category_id")
        return sorted(r["file_name"] for r in images.collect()), sorted(map(tuple, named.collect()))

    assert run("two", [["a", "bb"], ["bb", "ccc"]]) == run("one", [["a", "bb", "ccc"]])


def test_a_batch_is_not_numbered_in_one_task(spark):
    from pointweave.streaming import incremental

    df = incremental._numbered(spark.range(500).selectExpr("id % 50 as image_id", "id as x"), ["image_id", "x"], 7)
    assert "row_number() windowspecdefinition(_part#" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in df.orderBy("image_id", "x").collect()] == list(range(8, 508))


def test_streamed_images_have_suffixes_of_either_case(spark, tmp_path):
    from pointweave.streaming.incremental import image_stream

    for name in ("a.Jpg", "b.PNG", "c.txt", "d.jpeG", "e.jpg.part"):
        (tmp_path / name).write_bytes(b"x")
    query = image_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["image_name"] for r in spark.table("streamed").collect()) == ["a.Jpg", "b.PNG", "d.jpeG"]


def test_documents_are_written_in_pieces_and_whole_or_not_at_all(spark, tmp_path):
    target = tmp_path / "big.json"
    images = spark.range(1, 40).select("id", F.concat(F.lit('i"{'), "id", F.lit(".jpg")).alias("file_name"), F.lit(4).alias("width"), F.lit(3).alias("height"))
    marks = spark.range(500, 0, -1).select("id", (F.col("id") % 39 + 1).alias("image_id"), F.lit(2).alias("category_id"), F.array(F.array(F.lit(0.5), F.lit(1.0))).alias("segmentation"), F.array(F.lit(1.0)).alias("bbox"), F.lit(2.0).alias("area"), F.lit(0).alias("iscrowd"))
    categories = spark.createDataFrame([(2, "x")], "id int, name string")
    for pieces in (7, 1):  # the second takes the first one's place
        files.write_document(str(target), images, marks, categories, pieces)
        document = json.loads(target.read_text())
        assert [list(document), [a["id"] for a in document["annotations"]], [i["id"] for i in document["images"]]] == [["images", "annotations", "categories"], list(range(1, 501)), list(range(1, 40))]
        assert document["images"][1] == {"id": 2, "file_name": 'i"{2.jpg', "width": 4, "height": 3} and sorted(p.name for p in tmp_path.iterdir()) == ["big.json"]
    broken = marks.withColumn("area", F.when(F.col("id") == 250, F.raise_error(F.lit("no area")).cast("double")).otherwise(F.col("area")))
    with pytest.raises(Exception, match="no area"):
        files.write_document(str(tmp_path / "never.json"), images, broken, categories, 5)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["big.json"]
    files.write_document(str(tmp_path / "none.json"), images.limit(0), marks.limit(0), categories.limit(0))
    assert json.loads((tmp_path / "none.json").read_text()) == {"images": [], "annotations": [], "categories": []}


def test_orientations(spark):
    shown = {1: ["abc", "def"], 2: ["cba", "fed"], 3: ["fed", "cba"], 4: ["def", "abc"], 5: ["ad", "be", "cf"], 6: ["da", "eb", "fc"], 7: ["fc", "eb", "da"], 8: ["cf", "be", "ad"], None: ["abc", "def"], 9: ["abc", "def"]}
    rows = [(k, 3, 2, y, x, c, o) for k, o in enumerate(shown) for y, line in enumerate(["abc", "def"]) for x, c in enumerate(line)]
    got = files.oriented(spark.createDataFrame(rows, "image int, width int, height int, y int, x int, c string, orientation int")).collect()
    for k, lines in enumerate(shown.values()):
        own = {(r["y"], r["x"]): r["c"] for r in got if r["image"] == k}
        assert own == {(y, x): c for y, line in enumerate(lines) for x, c in enumerate(line)}
        assert {(r["width"], r["height"]) for r in got if r["image"] == k} == {(len(lines[0]), len(lines))}


def test_documents_are_read_in_splits(spark, tmp_path):
    marks = [{"id": k, "image_id": k % 5, "category_id": 1, "segmentation": [[k + 0.5, 1.0]], "bbox": [], "area": float(k), "iscrowd": 0, "note": {"of": [{"a": '}]"' + "\\" * (k % 4)}, {}]}} for k in range(60)]
    images = [{"id": k, "file_name": 'a{"[' * (k % 3) + "\\" * k + "}é", "width": k, "height": 2} for k in range(40)]
    document = {"info": {"x": [{"a": 1}], "b": {"annotations": [{"id": 7}]}}, "tags": ["[{", [1, [2]]], "images": images, "empty": [], "licenses": [{"id": 9}, {}], "note": 'a{"b', "annotations": marks, "categories": [{"id": 1, "name": "x"}, {"id": 2}], "last": {"annotations": {"id": 3}}}
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    kept = {"images": ("id", "file_name", "width"), "annotations": ("id", "image_id", "segmentation", "area"), "categories": ("id", "name")}
    try:
        for size, indent in (("300", None), ("1000", 1), (split, 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            (tmp_path / "d.json").write_text(json.dumps(document, indent=indent, ensure_ascii=bool(indent)) + "\n" * bool(indent))
            tables = files.read_document(spark, str(tmp_path / "d.json"))
            blocks = split_documents.fragments(spark, str(tmp_path / "d.json")).select("block").distinct().count()
            assert blocks > 9 if size != split else blocks == 1
            for name, columns in kept.items():
                got = sorted((r.asDict() for r in tables[name].select(*columns).collect()), key=lambda r: r["id"])
                assert got == [{c: e.get(c) for c in columns} for e in document[name]], name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_torn_and_empty_documents(spark, tmp_path):
    for text in ('{"images": [{"id": 1}, {"id": 2', '{"images": [{"id": 1}], "note": "a', '{"images": [[{"id": 1}]}'):
        (tmp_path / "torn.json").write_text(text)
        with pytest.raises(ValueError, match="whole"):
            files.read_document(spark, str(tmp_path / "torn.json"))
    for text in ("", "{}", '{"images": [], "annotations": []}'):
        (tmp_path / "none.json").write_text(text)
        assert [t.count() for t in files.read_document(spark, str(tmp_path / "none.json")).values()] == [0, 0, 0]
    (tmp_path / "bad.json").write_text('{"images": [{"id": 1}, {"id": oops}]}')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_document(spark, str(tmp_path / "bad.json"))["images"].collect()
