"""Point, image, segment, pixel and raster tables derived from the star-schema tables, one image a supplier.

The texts are read by Spark and by DuckDB alike, so a query and its SQL start from the same rows. A raster is
96 x 128 pixels; grid blocks of three sizes stand in for segmentation rounds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pointweave.plans.scratch import staged

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS = {
    "labelset": """
select * from (values
  ('C1', 1, 'Class one',   'Group A', 229,  68,  68),
  ('C2', 2, 'Class two',   'Group A', 255, 140,   0),
  ('C3', 3, 'Class three', 'Group B', 255, 255,   0),
  ('C4', 4, 'Class four',  'Group B',  68, 229, 202),
  ('C5', 5, 'Class five',  'Group C', 108,  68, 229)
) as t(short_code, class_id, name, functional_group, cr, cg, cb)""",
    "points": """
select cast(l_suppkey as bigint) as image_id,
  'G' || lpad(cast(l_suppkey as string), 7, '0') || case cast(l_suppkey % 5 as int)
    when 0 then '.jpg' when 1 then '.JPG.JPG' when 2 then ' (1).jpg' when 3 then '_copy.jpg' else '.png.png' end as image_name,
  cast((l_partkey * 7 + l_linenumber) % 98 as int) as y,
  cast((l_orderkey * 13 + l_partkey) % 132 as int) as x,
  'C' || cast(l_linenumber as string) as label,
  cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as bigint) as point_seq
from lineitem""",
    "part_points": """
select cast(l_partkey as bigint) as image_id,
  cast((l_suppkey * 31 + l_linenumber * 17 + l_orderkey) % 96 as double) as row,
  cast((l_orderkey * 13 + l_suppkey) % 128 as double) as col
from lineitem""",
    "images": """
select cast(s_suppkey as bigint) as image_id,
  'G' || lpad(cast(s_suppkey as string), 7, '0') || case when s_suppkey % 2 = 0 and s_suppkey % 5 = 4 then '.png'
    when s_suppkey % 5 = 4 then '.png.png' when s_suppkey % 5 = 1 then '.JPG' else '.jpg' end as image_name,
  128 as width, 96 as height
from supplier where s_acctbal >= 0
union all
select cast(1000000 + n_nationkey as bigint), 'N' || cast(n_nationkey as string) || '.jpg', 128, 96 from nation""",
    "grid": """
select a.y, b.x from (select distinct cast(l_partkey % 96 as int) as y from lineitem) a
cross join (select distinct cast(l_partkey % 128 as int) as x from lineitem) b""",
    "segments": """
select k.image_id, r.round, g.y, g.x, cast(floor(g.y / r.block) * 1000 + floor(g.x / r.block) as bigint) as segment_id
from (select distinct cast(l_suppkey as bigint) as image_id from lineitem) k
cross join grid g
cross join (values (0, 4.0), (1, 8.0), (2, 32.0)) as r(round, block)""",
    "segment_runs": """
select k.image_id, g.round, g.y, g.segment_id, g.x0, g.x1
from (select distinct cast(l_suppkey as bigint) as image_id from lineitem) k
cross join (
  select r.round, g.y, cast(floor(g.y / r.block) * 1000 + floor(g.x / r.block) as bigint) as segment_id, min(g.x) as x0, max(g.x) as x1
  from grid g cross join (values (0, 4.0), (1, 8.0), (2, 32.0)) as r(round, block) group by 1, 2, 3) g""",
    "pixels": """
select k.image_id, g.y, g.x,
  cast((floor(g.x / 16.0) * 40 + floor(g.y / 16.0) * 25 + (g.x * 7 + g.y * 3) % 5) % 256 as int) as b,
  cast((floor(g.x / 32.0) * 60 + k.image_id * 11 + (g.x + g.y) % 3) % 256 as int) as g,
  cast((floor(g.y / 24.0) * 50 + k.image_id * 5) % 256 as int) as r
from (select distinct cast(l_suppkey as bigint) as image_id from lineitem) k cross join grid g""",
    "voted": """
select image_id, round, segment_id, class_id, least(votes, 255) as votes from (
  select image_id, round, segment_id, class_id, n, sum(n) over (partition by image_id, round, segment_id) as votes,
    row_number() over (partition by image_id, round, segment_id order by n desc, s1) as k
  from (
    select s.image_id, s.round, s.segment_id, l.class_id, count(*) as n, min(p.point_seq) as s1
    from points p join labelset l on p.label = l.short_code
    join segments s on s.image_id = p.image_id and s.y = p.y and s.x = p.x
    group by s.image_id, s.round, s.segment_id, l.class_id) c) d
where k = 1""",
    "raster": """
select s.image_id, s.y, s.x, v.class_id from segments s
join voted v on v.image_id = s.image_id and v.round = s.round and v.segment_id = s.segment_id where s.round = 0""",
    "runs": """
select image_id, class_id, y, min(x) as x0, max(x) as x1 from (
  select image_id, class_id, y, x, x - row_number() over (partition by image_id, class_id, y order by x) as island from raster) t
group by image_id, class_id, y, island""",
}

#: What each view reads besides the base tables.
NEEDS = {
    "segments": ("grid",), "segment_runs": ("grid",), "pixels": ("grid",), "voted": ("labelset", "points", "segments"), "raster": ("segments", "voted"), "runs": ("raster",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    wanted: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += NEEDS.get(name, ())
    return [name for name in VIEWS if name in wanted]


def sql_with(*names: str, recursive: bool = False) -> str:
    """The WITH clause, open for more, that defines these views and all they need."""
    parts = ",\n".join(f"{name} as ({VIEWS[name]})" for name in _closure(names))
    return f"with {'recursive ' * recursive}{parts}"


#: Images whose pixels or segments one task makes and works on.
IMAGES_A_TASK = 64
#: Bytes of a shuffle, and of files with what opening them counts as, that one task takes of tables made from images. Runs
#: are packed closely, some 70,000 to the MB of a shuffle, so that Spark's 64 and 128 MB are millions of them.
SHUFFLED_A_TASK, READ_A_TASK = 8 << 20, 16 << 20
_IMAGES = "(select distinct cast(l_suppkey as bigint) as image_id from lineitem)"


def _bytes(size: str) -> int:
    """A size as Spark's settings have it: 8m, 64MB, 67108864b."""
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def _dealt_images(spark: SparkSession) -> DataFrame:
    """The numbers of all images, dealt to tasks by image, so that a task's share does not grow with the tables.

    The session's shuffles get as many partitions from now on, if it has fewer, and joins take tables that are dealt by
    image as they are, so that pixels stay where they are made. What Spark puts together for a task of later steps, of
    partitions of a shuffle and of files, is bounded as well, where the session allows more.
    """
    images = staged(spark.sql(_IMAGES), "images")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-images.count() // IMAGES_A_TASK))
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for setting, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED_A_TASK), ("spark.sql.files.maxPartitionBytes", READ_A_TASK)):
        if _bytes(spark.conf.get(setting)) > most:
            spark.conf.set(setting, str(most))
    return images.repartition(tasks, "image_id")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the whole of the base tables at sf_dir.

    Where the SQL crosses all images with a grid, the grid, which is of one image, is sent to the images: they are few
    bytes, so that Spark makes all pixels in one task if they are left as they are. Numbers with a point are doubles,
    as they are to DuckDB once divided; Spark's decimals take a microsecond a pixel each.
    """
    for table in BASE:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    sql = f"{sql_with(name)} select * from {name}"
    if _IMAGES in sql:
        _dealt_images(spark).createOrReplaceTempView("dealt_images")
        sql = sql.replace(_IMAGES, "dealt_images").replace("select k.image_id", "select /*+ broadcast(g), broadcast(r) */ k.image_id")
        sql = re.sub(r"\b(\d+\.\d+)\b", r"\1D", sql)
    return spark.sql(sql)
