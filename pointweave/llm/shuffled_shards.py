"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash; Spark's exchange carries
them. Pass two shuffles each bucket by Fisher-Yates. Buckets in order make one random permutation of all records,
which is cut into shards whose row counts are at most one apart, and written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.tables import table
from pointweave.plans.scratch import scratch_path, staged

SHARDS = 24
SEED = 4
#: Bytes of text that a bucket holds on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 128
#: Bytes of a group of neighbouring buckets, which one task takes, so that a file of a shard is not smaller; and bytes of a partition.
GROUP_BYTES, PARTITION_BYTES = 64 << 20, 256 << 20
#: Equal records beyond this number are scattered one by one.
REPEATED = 64
#: Groups up to which their starts (16 bytes each) are broadcast.
BROADCAST_GROUPS = 2_000_000


def record_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def fisher_yates(n: int, seed: list[int]) -> list[int]:
    """A uniform permutation: from the last place down, each takes one of the places not yet fixed."""
    order = list(range(n))
    draws = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs (doc_id, text) plus position: their place, from 0, in one random permutation of all rows.

    The permutation depends on the seed, the records and the bucket size, not on how the input is partitioned.
    Neighbouring buckets form groups that one task takes; partitions follow the bytes of the input. Rows with the same id and text share a hash; where there are many, each draws its bucket by itself.
    """
    rows = docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text")).withColumn("_bytes", record_size())
    total, count = rows.agg(F.sum("_bytes"), F.count("*")).first()
    groups = max(LEAST_BUCKETS, math.ceil((total or 0) / GROUP_BYTES))
    buckets = max(groups, math.ceil((total or 0) / bucket_bytes))
    partitions = math.ceil((total or 0) / PARTITION_BYTES)
    hot = staged(rows.groupBy("doc_id", "_text_hash").agg(F.count("*").alias("n")).filter(F.col("n") > REPEATED).select("doc_id", "_text_hash"), "repeated")
    spread = F.lit(0).cast("long")
    if hot.limit(1).count():
        rows = rows.join(hot.withColumn("_hot", F.lit(1)), (rows["doc_id"].eqNullSafe(hot["doc_id"])) & (rows["_text_hash"] == hot["_text_hash"]), "left").select(rows["*"], "_hot")
        spread = F.when(F.col("_hot") == 1, F.floor(F.rand(seed) * (1 << 40))).otherwise(0)
        rows = staged(rows.withColumn("_bucket", _bucket(spread, seed, buckets)).drop("_hot"), "scattered")
    else:
        rows = rows.withColumn("_bucket", _bucket(spread, seed, buckets))
    rows = rows.withColumn("_group", F.floor(F.col("_bucket") * groups / buckets).cast("long"))
    sizes = staged(rows.groupBy("_group").agg(F.count("*").alias("_n")), "sizes")
    # A running sum in two levels, so that no task orders all groups.
    sizes = sizes.withColumn("_part", F.floor(F.col("_group") / 4096))
    parts = sizes.groupBy("_part").agg(F.sum("_n").alias("_part_n"))
    parts = parts.select("_part", (F.sum("_part_n").over(W.orderBy("_part")) - F.col("_part_n")).alias("_before_part"))
    starts = sizes.join(parts, "_part").select("_group", (F.sum("_n").over(W.partitionBy("_part").orderBy("_group")) - F.col("_n") + F.col("_before_part")).alias("_start"))
    if groups <= BROADCAST_GROUPS:
        starts = F.broadcast(starts)
    more = partitions > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.drop("_bytes").repartition(*([partitions] if more else []), "_group")
    row = F.row_number().over(W.partitionBy("_group").orderBy("_bucket"))
    dealt = dealt.join(starts, "_group").withColumn("_row", row).select("_group", "_bucket", "_start", "_row", "doc_id", "text", "_text_hash")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shuffle(bucket: pa.Table) -> pa.Table:
        start = bucket.column("_start")[0].as_py() + pc.min(bucket.column("_row")).as_py() - 1
        order = pc.sort_indices(bucket, [("doc_id", "ascending"), ("_text_hash", "ascending")], null_placement="at_start")
        out = bucket.take(order.take(pa.array(fisher_yates(len(bucket), [seed, bucket.column("_bucket")[0].as_py()]), pa.int64())))
        return pa.table({"doc_id": out.column("doc_id"), "text": out.column("text"), "position": pa.array(start + np.arange(len(bucket)))})

    return dealt.groupBy("_group", "_bucket").applyInArrow(shuffle, f"doc_id {kind}, text string, position long")


def _bucket(spread, seed: int, buckets: int):
    return F.pmod(F.xxhash64("doc_id", "_text_hash", spread, F.lit(seed)), F.lit(buckets)).cast("long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Parquet at path, a folder shard=k for each shard: doc_id, text, slot (place in the shard, gapless from 0).

    Row counts of shards are at most one apart. Null ids, null and empty texts and repeated rows are records like
    others; ids keep their type and value; texts of any length are written whole, a bucket that holds one being
    greater by it; other columns are not written; an empty table gives no rows.
    """
    count = docs.count()
    least, more = divmod(count, shards)
    edge = (least + 1) * more  # positions below it lie in the shards that have one more
    p = F.col("position")
    first = F.floor(p / F.lit(least + 1)) if count else F.lit(0)
    shard = F.when(p < edge, first).otherwise(more + F.floor((p - edge) / F.lit(max(least, 1))))
    start = F.when(p < edge, F.col("shard") * (least + 1)).otherwise(edge + (F.col("shard") - more) * least)
    placed = shuffled(docs, seed, bucket_bytes).withColumn("shard", shard.cast("int")).withColumn("slot", (p - start).cast("long")).drop("position")
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, text string, slot bigint, shard int").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of the written shards read back."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "shards")
    write_shards(docs, path)
    return read_shards(spark, path).select(
        "doc_id", record_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
