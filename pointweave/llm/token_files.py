"""Token ids as Parquet list columns: dictionary or delta encoding, small row groups and pages with page indexes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.token_ids import encoder
from pointweave.plans.scratch import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that go into one file, and those that a small table's files hold at least.
FILE_BYTES, LEAST_FILE_BYTES = 32 << 20, 1 << 20
#: Files up to which their starts (16 bytes each) are broadcast instead of shuffling the ids.
BROADCAST_FILES = 500_000


def file_count(docs: DataFrame, file_bytes: int) -> int:
    """Files of about file_bytes of text each, ids taking about as much; less for small tables, so that all tasks have some."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = total // docs.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(total / min(file_bytes, max(LEAST_FILE_BYTES, share))))


def write_token_files(
    docs: DataFrame,
    path: str,
    encoding: str = "dictionary",
    row_group_bytes: int = 8 << 20,
    page_bytes: int = 64 << 10,
    page_rows: int = 512,
    file_bytes: int = FILE_BYTES,
    vocabulary_name: str = VOCABULARY,
) -> None:
    """Files part-00000.. at path, documents in ascending order of doc_id through and over the files.

    Columns: doc_id, n_tokens, file_start (ids of the documents before it in its file), ids array<int> with the
    end id. encoding is 'dictionary' (bit-packed indexes) or 'delta' (delta binary packed). Page indexes are
    written for every column, so a filter on doc_id reads the pages that may hold it. Texts, not ids, are
    shuffled, being the smaller. Null ids come first; null and empty texts hold the end id alone; ties are
    ordered at random, so a repeated id is spread like any other. A text of any length is one list.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, at = encoder(vocabulary_name).encode_all, 0
        for batch in batches:
            ids = [x + end for x in encode_all(batch.column(1).to_pylist())]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(at + ends[:-1], pa.int64()), lists], names=["doc_id", "n_tokens", "file_start", "ids"])
            at += int(ends[-1])

    order = ["doc_id", "_any"]
    limit_batches(spark)
    ordered = (
        docs.select("doc_id", "text", F.rand(7).alias("_any"))
        .repartitionByRange(file_count(docs, file_bytes), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
    }
    ordered.mapInArrow(encode, f"doc_id {kind}, n_tokens long, file_start long, ids array<int>").write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' columns plus start, the ids of all documents before it. Reading only some columns, or some ids, reads no more."""
    files = spark.read.parquet(path)
    rows = files.withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    sums = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.select("_file", (F.sum("_sum").over(W.orderBy("_file")) - F.col("_sum")).alias("_before"))  # a row a file
    if len(files.inputFiles()) <= BROADCAST_FILES:
        before = F.broadcast(before)
    return rows.join(before, "_file").withColumn("start", F.col("_before") + F.col("file_start")).drop("_file", "_before", "file_start")


def token_file_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_token_files() returns."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_file_digests(read_token_files(spark, path))
