"""Exact top-k inner products by a bit-sliced index.

Rows are indexed in blocks. A block keeps, for every attribute, the upper bits of its quantised values as slices: one
bitmap over the block's rows a bit. A query adds the slices, shifted by the bits of its own values, with bitmap
arithmetic (carry-save adders over all bitmaps of one weight at a time), which gives the slices of an approximate sum
of every row. The top rows are selected from the most significant slice downward; rows whose sum is within the greatest
error of the bits left out of the last of them, and of the best rows so far, are resolved exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, table
from pointweave.plans.scratch import staged

LIMIT, SCALE, EVERY = 5, 256, 50
#: Upper bits of a value that become slices.
SLICES = 6
#: Bytes of a block's values.
BLOCK_BYTES = 2 << 20
#: Bytes of the queries of one pass over the blocks; more queries take more passes.
QUERY_BYTES = 16 << 20

_BLOCK = "length int, n int, slices int, shift int, spread double, greatest long, bitmaps binary, values binary, keys array<long>, ids array<long>"


def packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (as 64-bit words) of the last axis of 0 and 1; its length is a multiple of 64."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def sliced(values: np.ndarray, slices: int = SLICES) -> tuple[np.ndarray, int, int, float]:
    """(bitmaps attributes x slices x words, number of slices, bits left out, greatest distance of what is left out from its middle).

    Slices hold values >> bits left out, plus half their range, least significant first.
    """
    n, length = values.shape
    whole = max(int(np.maximum(values, ~values).max(initial=0)).bit_length() + 1, 1)
    kept = min(slices, whole)
    shift = whole - kept
    upper = (values >> shift) + (1 << (kept - 1))
    padded = np.zeros((length, -(-n // 64) * 64), np.int64)
    padded[:, :n] = upper.T
    bitmaps = np.stack([packed(((padded >> b) & 1).astype(np.uint8)) for b in range(kept)], axis=1)
    rest = (values & ((1 << shift) - 1)) - ((1 << shift) - 1) / 2
    return bitmaps, kept, shift, float(np.sqrt((rest * rest).sum(axis=1)).max(initial=0.0))


def added(weighted: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps: weighted[w] (m x words) count 2 ** w each."""
    words, out, carries, weight = weighted[0].shape[1], [], [], 0
    while weight < len(weighted) or carries:
        stack = np.concatenate([*weighted[weight : weight + 1], *carries, np.zeros((0, words), np.uint64)])
        carries = []
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            else:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        weight += 1
    return out


def kth_value(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th greatest number of the rows, from the most significant slice downward; there are k rows at least."""
    value, sure, open_ = 0, 0, rows
    for b in range(len(slices) - 1, -1, -1):
        high = open_ & slices[b]
        count = sure + int(np.bitwise_count(high).sum())
        if count >= k:
            value, open_ = value | 1 << b, high
        else:
            sure, open_ = count, open_ & ~slices[b]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """The bitmap of the rows whose number is at least the bound."""
    if bound <= 0:
        return rows
    if bound >> len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for b in range(len(slices) - 1, -1, -1):
        if bound >> b & 1:
            equal = equal & slices[b]
        else:
            above, equal = above | (equal & slices[b]), equal & ~slices[b]
    return above | equal


class Block:
    def __init__(self, row: dict):
        self.n, self.length, self.kept, self.shift, self.spread = row["n"], row["length"], row["slices"], row["shift"], row["spread"]
        self.greatest = row["greatest"]
        self.values = np.frombuffer(row["values"], np.int64).reshape(self.n, self.length)
        self.bitmaps = np.frombuffer(row["bitmaps"], np.uint64).reshape(self.length, self.kept, -1)
        self.keys = np.array(row["keys"], np.int64)
        self.nameless = np.array([i is None for i in row["ids"]])
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        present = np.zeros(self.bitmaps.shape[2] * 64, np.uint8)
        present[: self.n] = 1
        self.rows = packed(present)

    def boundary(self, query: np.ndarray, k: int, least: int | None) -> np.ndarray:
        """Rows that may be among the block's k best and may score least or more."""
        size, negative = np.abs(query), query < 0
        signed = np.where(negative[:, None, None], ~self.bitmaps, self.bitmaps)
        bits = (size[:, None] >> np.arange(max(int(size.max()).bit_length(), 1))) & 1
        weighted = []
        for weight in range(bits.shape[1] + self.kept - 1):
            picks = [(np.flatnonzero(bits[:, weight - b]), b) for b in range(self.kept) if 0 <= weight - b < bits.shape[1]]
            weighted.append(np.concatenate([signed[d, b] for d, b in picks]))
        sums = added(weighted)
        lost, total, below = (1 << self.shift) - 1, int(query.sum()), int(size[negative].sum())
        base = -(((1 << self.kept) - 1) * below + (1 << (self.kept - 1)) * total) << self.shift
        around = math.sqrt(float((query.astype(np.float64) ** 2).sum())) * self.spread
        low = max(-below * lost, math.floor(lost / 2 * total - around) - 1)
        high = min((int(size.sum()) - below) * lost, math.ceil(lost / 2 * total + around) + 1)
        cut = 0
        if self.n >= k:
            cut = kth_value(sums, self.rows, k) - ((high - low) >> self.shift)
        if least is not None:
            cut = max(cut, -((base + high - least) >> self.shift))
        found = at_least(sums, self.rows, cut)
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: self.n])


def blocked(vectors: DataFrame, slices: int = SLICES) -> DataFrame:
    """Blocks of vectors (key, id, v array<double>, all finite) of one length."""

    def made(length: int, rows: list[tuple]) -> dict:
        values = np.concatenate([r[2] for r in rows])
        bitmaps, kept, shift, spread = sliced(values, slices)
        return {
            "length": length, "n": len(values), "slices": kept, "shift": shift, "spread": spread, "greatest": int(np.abs(values).max(initial=0)), "bitmaps": bitmaps.tobytes(), "values": values.tobytes(),
            "keys": [k for r in rows for k in r[0]], "ids": [i for r in rows for i in r[1]],
        }

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        out = lambda row: pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(names, kinds)], names=names)
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            keys, ids, v = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            starts = v.offsets.to_numpy()
            numbers = v.values.to_numpy()
            lengths = np.diff(starts)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                scaled = np.floor(SCALE * numbers[starts[rows][:, None] + np.arange(length)])
                if np.abs(scaled).max(initial=0.0) >= 2.0**53:
                    raise OverflowError("a component is too great for inner products of 64 bits")
                most = max(64, BLOCK_BYTES // (8 * length) // 64 * 64)
                for first in range(0, len(rows), most):
                    own = rows[first : first + most]
                    held = waiting.setdefault(length, [])
                    held.append((keys[own].tolist(), [ids[i] for i in own], scaled[first : first + most].astype(np.int64)))
                    while sum(len(r[0]) for r in held) >= most:
                        all_keys, all_ids, all_values = [k for r in held for k in r[0]], [i for r in held for i in r[1]], np.concatenate([r[2] for r in held])
                        yield out(made(length, [(all_keys[:most], all_ids[:most], all_values[:most])]))
                        held[:] = [(all_keys[most:], all_ids[most:], all_values[most:])] if len(all_keys) > most else []
        for length, held in waiting.items():
            if held:
                yield out(made(length, held))

    return vectors.mapInArrow(build, _BLOCK)


def _answered(queries: dict[int, list[tuple[int, np.ndarray]]], limit: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # query key: (scores, nameless, ids, keys), in order
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for key, query in queries.get(block.length, ()):
                    if int(np.abs(query).max(initial=0)) * block.greatest * block.length >= 1 << 63:
                        raise OverflowError("inner products leave 64 bits")
                    held = best.get(key)
                    least = int(held[0][limit - 1]) if held and len(held[0]) >= limit else None
                    rows = block.boundary(query, limit + 1, least)  # one more, as the query may be among them
                    rows = rows[block.keys[rows] != key]
                    if not len(rows):
                        continue
                    found = (block.values[rows] @ query, block.nameless[rows], block.ids[rows])
                    if held:
                        found = tuple(np.concatenate(pair) for pair in zip(held, found))
                    order = np.lexsort((found[2], found[1], -found[0]))[:limit]
                    best[key] = tuple(c[order] for c in found)
        keys = [k for k, held in best.items() for _ in held[0]]
        columns = [np.concatenate([held[c] for held in best.values()]) if best else np.zeros(0, np.int64) for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(columns[2].astype(np.int64), mask=columns[1].astype(bool)), pa.array(columns[0].astype(np.int64))], names=["key", "vec_id", "score"])

    return answer


def _picked(every: int):
    """The queries among the rows of blocks: (key, query_id, values)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["values"], np.int64).reshape(row["n"], row["length"])
                own = [i for i, d in enumerate(row["ids"]) if d is not None and d % every == 0]
                yield pa.RecordBatch.from_arrays([pa.array([row["keys"][i] for i in own], pa.int64()), pa.array([row["ids"][i] for i in own], pa.int64()), pa.array([values[i].tolist() for i in own], pa.list_(pa.int64()))], names=["key", "query_id", "v"])

    return pick


def nearest(embeddings: DataFrame, limit: int = LIMIT, every: int = EVERY, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible, the other rows of the greatest inner product
    of components floor(256 x), equal ones by the smaller vec_id.

    Vectors that are null or empty, or hold a null or non-finite component, take no part; vectors of another length
    than a query's are no candidates of it. Every row counts by itself: rows repeated under one vec_id are
    candidates of one another and queries of their own, each with ranks from 1. A null vec_id is no query and comes
    last among equal scores. Scores beyond 64 bits raise OverflowError. Other columns are not read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    limit_batches(spark)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    blocks = staged(blocked(rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & sound), slices), "blocks")
    queries = staged(blocks.select("length", "n", "values", "keys", "ids").mapInArrow(_picked(every), "key long, query_id long, v array<long>"), "queries")
    size = queries.agg(F.coalesce(F.sum(F.size("v") * 8 + 64), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / QUERY_BYTES))
    found = None
    for number in range(passes):
        own = queries.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == number).select("key", "v").collect()  # a pass's, of bounded bytes
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in own:
            by_length.setdefault(len(r["v"]), []).append((r["key"], np.array(r["v"], np.int64)))
        part = staged(blocks.mapInArrow(_answered(by_length, limit), "key long, vec_id long, score long"), "answers")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return best.join(queries.select("key", "query_id"), "key").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: The same result by scoring every pair.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v))
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5
"""
