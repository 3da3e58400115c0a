"""Vector best-fit packing of documents into sequences.

A piece asks for three things: tokens, one document place, and attention cost n * (n + 1) / 2 (causal attention
stays inside a document). All three follow from its length, so the packing is planned on the histogram of
lengths: at most max_tokens rows, whatever the corpus. Lengths are placed longest first; a group of equal bins
is chosen among those in which every constraint holds, by the weighted dot-product of demand and residual, or by
the weighted norm of what would be left. The plan's intervals then join to the pieces, which are numbered within
their length, and Spark gives each its sequence and offset.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.token_ids import encoder
from pointweave.plans.scratch import staged

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Intervals up to which the plan is broadcast (40 bytes each); a larger one is joined by shuffle.
BROADCAST_INTERVALS = 500_000
#: Numbers of a cell of the plan's intervals.
STEP = 4_096
SEED = 3
#: Pieces that one numbering group holds on average at most.
RANK_GROUP = 20_000


def attention_cost(length):
    return length * (length + 1) // 2


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, attention cost (None: no bound of its own)."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        cost = attention_cost(self.tokens) if self.cost is None else self.cost
        return np.array([self.tokens, documents, cost], np.int64)


def plan_packing(histogram: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)):
    """Bins for a histogram {length: pieces}: ([(contents, bins)], intervals).

    contents: lengths in order of place. intervals: (length, first rank, pieces, first sequence, offset); the piece
    of that length and rank r lies in sequence first + r - rank. Raises ValueError on a length that fits no bin.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule: {rule}")
    full, w = capacity.vector(), np.array(weights)
    lengths = sorted((n for n, c in histogram.items() if c), reverse=True)
    size = 1024
    left = np.zeros((size, 3), np.int64)
    bins = np.zeros(size, np.int64)
    contents: list[tuple[int, ...]] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def add(residual, count, held):
        nonlocal left, bins, size
        if len(contents) == size:
            left, bins, size = np.vstack([left, np.zeros_like(left)]), np.concatenate([bins, np.zeros_like(bins)]), 2 * size
        left[len(contents)], bins[len(contents)] = residual, count
        contents.append(held)

    for at, length in enumerate(lengths):
        need = np.array([length, 1, attention_cost(length)], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence of {full.tolist()}")
        remaining = histogram[length]
        while remaining:
            now = len(contents)
            fits = np.flatnonzero((bins[:now] > 0) & (left[:now] >= need).all(axis=1))
            if not len(fits):
                each = int((full // need).min())  # a new bin takes as many of this length as it can
                count = remaining // each
                if not count:
                    each, count = remaining, 1
                add(full - each * need, count, (length,) * each)
                remaining -= each * count
                continue
            rest = left[fits]
            if rule == "norm":
                score = -(w * ((rest - need) / full) ** 2).sum(axis=1)
            else:
                score = (w * (rest / full) * (need / full)).sum(axis=1)
            best = int(fits[np.argmax(score)])
            each = min(int((left[best] // need).min()), remaining) if rule == "norm" else 1  # by norm a bin just chosen stays the best
            count = min(int(bins[best]), remaining // each)
            bins[best] -= count
            add(left[best] - each * need, count, contents[best] + (length,) * each)
            remaining -= each * count
        if at + 1 < len(lengths):  # bins that nothing left fits into are closed
            need = np.array([lengths[-1], 1, attention_cost(lengths[-1])])
            keep = np.flatnonzero((bins[: len(contents)] > 0) & (left[: len(contents)] >= need).all(axis=1))
            if len(keep) < len(contents) // 2:
                kept = set(keep.tolist())
                done += [(contents[i], int(bins[i])) for i in range(len(contents)) if bins[i] and i not in kept]
                held, l, b = [contents[i] for i in keep], left[keep], bins[keep]
                contents, left, bins = held, np.vstack([l, np.zeros((1024, 3), np.int64)]), np.concatenate([b, np.zeros(1024, np.int64)])
                size = len(bins)
    done += [(contents[i], int(bins[i])) for i in range(len(contents)) if bins[i]]

    rank = dict.fromkeys(lengths, 0)
    intervals, sequence = [], 0
    for held, count in done:
        offset = 0
        for length in held:
            intervals.append((length, rank[length], count, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return done, intervals


def pieces(docs: DataFrame, max_tokens: int, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' ids, the end id included, cut to max_tokens.

    Every piece but a document's first has max_tokens tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(vocabulary_name).encode_all
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode_all(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // max_tokens)):
                    to = (n - 1) % max_tokens + 1 + k * max_tokens
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at = to
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    limit_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, capacity: Capacity, rule: str = "norm") -> DataFrame:
    """parts (with length and, to number them, doc_id and piece) plus sequence_id and offset.

    parts is written with a random salt first. Numbers within a length are given in salted groups of bounded size and
    moved by the groups' counts, so a length that a third of all pieces have, or a piece that is repeated so often,
    is not in one task. The plan's intervals are cut at a grid of STEP numbers, so that a piece looks at the few of its cell only.
    """
    spark = parts.sparkSession
    parts = staged(parts.withColumn("_salt", F.floor(F.rand(SEED) * (1 << 30)).cast("long")), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity.tokens rows
    _, intervals = plan_packing(histogram, capacity, rule)
    salts = max(16, math.ceil(max(histogram.values(), default=0) / RANK_GROUP))
    salted = parts.withColumn("_group", F.col("_salt") % salts)
    counts = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_group", (F.sum("_n").over(W.partitionBy("length").orderBy("_group")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_group").orderBy("_salt", "doc_id", "piece")) - 1
    ranked = salted.withColumn("_own", own).join(before, ["length", "_group"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    ranked = ranked.withColumn("_cell", F.floor(F.col("_rank") / STEP))
    plan = spark.createDataFrame(intervals, "length long, _first long, _count long, _sequence long, offset long")
    cells = F.sequence(F.floor(F.col("_first") / STEP), F.floor((F.col("_first") + F.col("_count") - 1) / STEP))
    plan = plan.withColumn("_cell", F.explode(cells))
    if len(intervals) + sum(histogram.values()) // STEP <= BROADCAST_INTERVALS:
        plan = F.broadcast(plan)
    inside = (ranked["_rank"] >= plan["_first"]) & (ranked["_rank"] < plan["_first"] + plan["_count"])
    return ranked.join(plan, (ranked["length"] == plan["length"]) & (ranked["_cell"] == plan["_cell"]) & inside).select(
        *[ranked[c] for c in parts.columns if c != "_salt"], (plan["_sequence"] + ranked["_rank"] - plan["_first"]).alias("sequence_id"), plan["offset"]
    )


def packed_sequences(docs: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Every document's pieces with sequence_id and offset, gapless from 0 in each sequence.

    Null and empty texts are documents of the end id alone; null ids and repeated rows are packed like others;
    other columns are not read; an empty table gives no rows. Only documents longer than a sequence are cut.
    """
    return pack(pieces(docs, capacity.tokens, vocabulary_name), capacity, rule)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"))
