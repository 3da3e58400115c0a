"""Near-duplicate documents by b-bit MinHash.

Texts with the same shingle set form a class, and one row of it goes on. Its minima give band keys and a packed
signature of their low bits. Rows that share a band key, a bucket, are candidates; a pair is looked at if the
similarity estimated from equal low bits, corrected for chance collisions, can reach the threshold, and is a link
if the full shingle sets confirm it. Buckets are searched in three rounds, each among rows not yet connected:

1. every row with its bucket's smallest id, which connects most groups of copies by one pair a row;
2. in buckets of up to SMALL_BUCKET rows the other pairs; in larger ones every row outside the largest component
   with a member of it, another one in each bucket;
3. in larger buckets that still hold several components, all rows of different components: blocks of signatures
   meet first, and then the sets of rows that some signature there matches.

No bucket is capped, no row is written for each pair of a group, and a chain is not closed before it is confirmed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, small_side, table
from pointweave.llm.words import mix, shingles
from pointweave.operators.graph import connected_components
from pointweave.plans.scratch import staged

WORDS = 5
SIMILARITY = 0.75
#: A pair at the threshold shares no band with probability (1 - 0.75 ** 5) ** 40, about 2e-5.
BANDS, BAND_ROWS = 40, 5
MINIMA = BANDS * BAND_ROWS
#: Low bits kept of each minimum; 16 of them fill a 64-bit word.
BITS, PER_WORD = 4, 16
#: Estimates this many standard errors below the threshold still pass.
SIGMAS = 4.0
SMALL_BUCKET = 16
#: Rows of a block of the third round, and shingles of its sets, on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19

_PADDING = -MINIMA % PER_WORD
_WORDS_PACKED = (MINIMA + _PADDING) // PER_WORD
_RANDOM = np.random.default_rng(20240607)
_MULTIPLY = _RANDOM.integers(0, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**64, MINIMA, np.uint64)
_NIBBLES = 0x1111111111111111


def least_equal(similarity: float = SIMILARITY, minima: int = MINIMA, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """Equal low bits that a pair at the similarity has, but for sigmas standard errors: minima agree by
    similarity, and the others by chance in one of 2 ** bits cases."""
    chance = 2.0**-bits
    p = similarity + (1 - similarity) * chance
    return math.floor(minima * p - sigmas * math.sqrt(minima * p * (1 - p)))


def estimated_similarity(equal: float, minima: int = MINIMA, bits: int = BITS) -> float:
    """The share of equal low bits, corrected for chance collisions."""
    chance = 2.0**-bits
    return max(0.0, (equal / minima - chance) / (1 - chance))


def minima(keys: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set: multiply-adds modulo 2 ** 64 of keys that are mixed already."""
    least = np.full(MINIMA, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(keys), 256):
        part = keys[at : at + 256, None] * _MULTIPLY[None, :]
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least)


def packed(least: np.ndarray) -> np.ndarray:
    low = np.concatenate([least & np.uint64(15), np.zeros(_PADDING, np.uint64)]).reshape(_WORDS_PACKED, PER_WORD)
    return np.bitwise_or.reduce(low << (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        out = mix(out + least[i::BAND_ROWS])
    return out


def equal_low_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the packed groups are equal, for every row of a against every row of b."""
    x = a[:, None, :] ^ b[None, :, :]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(_NIBBLES)
    return MINIMA - np.bitwise_count(x).sum(axis=2, dtype=np.int64)


def _list(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, digest_a, digest_b, low_bits, bands): two digests name the set, nulls where it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second, low, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                keys = shingles(text, WORDS)
                n.append(len(keys))
                if len(keys):
                    least = minima(keys)
                    one, two = np.add.reduce(mix(keys + np.uint64(1))), np.add.reduce(mix(keys ^ np.uint64(0x5555555555555555)))
                    first.append(int(one.view(np.int64)))
                    second.append(int(two.view(np.int64)))
                    low.append(packed(least))
                    bands.append(band_keys(least))
                else:
                    first.append(None)
                    second.append(None)
                    low.append(np.empty(0, np.uint64))
                    bands.append(np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _list(low), _list(bands)],
                names=["id", "n_shingles", "digest_a", "digest_b", "low_bits", "bands"],
            )

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(sign, "id long, n_shingles long, digest_a long, digest_b long, low_bits array<long>, bands array<long>")


def _low_bits_equal(a: str, b: str):
    """How many groups of two packed signatures are equal, on the JVM."""
    differ = F.lit(0)
    for i in range(_WORDS_PACKED):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_NIBBLES)))
    return F.lit(MINIMA) - differ


def bucket_members(first: DataFrame) -> DataFrame:
    """(key, id, n, least) of the rows of buckets with n > 1 rows."""
    banded = first.select("id", F.explode("bands").alias("key"))
    buckets = staged(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1"), "buckets")
    return banded.join(buckets, "key")


def alike(pairs: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and estimated similarity can reach the threshold."""
    a, b = (first.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("low_bits").alias(f"bits_{x}")) for x in "ab")
    sizes = 100 * F.least("n_a", "n_b") >= round(100 * similarity) * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").filter(sizes & (_low_bits_equal("bits_a", "bits_b") >= least_equal(similarity))).select("a", "b").distinct()


def small_bucket_pairs(member: DataFrame) -> DataFrame:
    """(a, b) of different components in buckets of few rows, those with the bucket's smallest id left out."""
    few = member.filter((F.col("n") <= SMALL_BUCKET) & (F.col("id") != F.col("least")))
    lists = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "component"))).alias("rows"))  # of up to SMALL_BUCKET rows
    return (
        lists.filter("size(rows) > 1").groupBy("rows").agg(F.lit(1))  # the same rows often share several bands
        .select("rows", F.posexplode("rows").alias("at", "a"))
        .select("a", F.explode(F.expr("slice(rows, at + 2, size(rows))")).alias("b"))
        .filter("a.component <> b.component and a.id < b.id")
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct()
    )


def stray_pairs(member: DataFrame) -> DataFrame:
    """(a, b) of every row outside a large bucket's largest component with a member of that, chosen at random by bucket."""
    many = member.filter(F.col("n") > SMALL_BUCKET)
    groups = many.groupBy("key", "component").agg(F.count("*").alias("rows"), F.min(F.struct(F.xxhash64("id", "key"), "id")).alias("chosen"))
    largest = groups.groupBy("key").agg(F.max(F.struct("rows", "component", "chosen")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    largest = staged(largest.select("key", F.col("top.component").alias("_top"), F.col("top.chosen.id").alias("_chosen")), "largest")
    return many.join(largest, "key").filter("component <> _top").select(F.least("id", "_chosen").alias("a"), F.greatest("id", "_chosen").alias("b")).distinct()


def block_rows(member: DataFrame, first: DataFrame) -> DataFrame:
    """(key, bi, bj, block, id, component, n_shingles, low_bits): rows of large buckets with several components, in every
    pair of blocks in which they may meet a row of another component.

    Rows of a component that fills a block have blocks of their own, which do not meet one another; the rows of all
    smaller ones share theirs.
    """
    sized = member.filter(F.col("n") > SMALL_BUCKET).join(first.select("id", "n_shingles"), "id")
    groups = staged(sized.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles")), "groups")
    own = F.when(F.col("rows") >= BLOCK, F.col("component"))  # null: with others
    blocks = groups.withColumn("own", own).groupBy("key", "own").agg(
        F.ceil(F.greatest(F.sum("rows") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("parts")
    )
    placed = blocks.select("key", "own", "blocks", "parts", (F.sum("blocks").over(W.partitionBy("key").orderBy("own")) - F.col("blocks")).cast("int").alias("start"))
    total = placed.groupBy("key").agg(F.sum("blocks").cast("int").alias("total"), F.sum("parts").alias("parts")).filter("parts > 1").drop("parts")
    placed = staged(placed.drop("parts").join(total, "key").select("key", F.coalesce("own", F.lit(_SHARED)).alias("own"), "blocks", "start", "total"), "placed")
    apart = groups.select("key", "component", F.coalesce(own, F.lit(_SHARED)).alias("own")).join(placed, ["key", "own"])
    at = (F.col("start") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: (F.col("own") == _SHARED) | (o < F.col("start")) | (o >= F.col("start") + F.col("blocks")))
    rows = member.filter(F.col("n") > SMALL_BUCKET).select("key", "id", "component").join(apart, ["key", "component"])
    rows = rows.select("key", "id", "component", at.alias("block"), F.explode(others).alias("other"))
    signed = first.select("id", "n_shingles", "low_bits")
    return rows.join(signed, "id").select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "id", "component", "n_shingles", "low_bits")


#: In place of a component, for rows whose blocks are shared.
_SHARED = -(1 << 63)


def _possible(block: pd.DataFrame, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): rows of a pair of blocks, j > i, that may be linked by size and signature and are of different components."""
    percent, bar = round(100 * similarity), least_equal(similarity)
    low = np.vstack(block["low_bits"].to_list()).view(np.uint64)
    sizes, component, side = block["n_shingles"].to_numpy(), block["component"].to_numpy(), block["block"].to_numpy()
    between = block["bi"].iloc[0] != block["bj"].iloc[0]
    for i in range(len(block) - 1):
        n, rest = sizes[i], sizes[i + 1 :]
        may = (component[i + 1 :] != component[i]) & (100 * np.minimum(n, rest) >= percent * np.maximum(n, rest))
        if between:
            may &= side[i + 1 :] != side[i]
        js = np.flatnonzero(may) + i + 1
        if len(js):
            js = js[equal_low_bits(low[i : i + 1], low[js])[0] >= bar]
            if len(js):
                yield i, js


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _matched(similarity: float):
    def match(block: pd.DataFrame) -> pd.DataFrame:
        """The rows of a pair of blocks that some signature of another component there matches."""
        found = np.zeros(len(block), bool)
        for i, js in _possible(block, similarity):
            found[i] = found[js] = True
        return block.loc[found, ["key", "bi", "bj", "block", "id", "component", "n_shingles", "low_bits"]]

    return match


def _confirmed(similarity: float):
    percent = round(100 * similarity)

    def confirm(block: pd.DataFrame) -> pd.DataFrame:
        """Links within a block, or between two, as a forest over their components."""
        names, node = np.unique(block["component"].to_numpy(), return_inverse=True)
        sets, ids, forest, out = [np.asarray(k) for k in block["keys"]], block["id"].to_numpy(), _Forest(len(names)), []
        for i, js in _possible(block, similarity):
            for j in js.tolist():
                if forest.root(node[i]) != forest.root(node[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        forest.join(node[i], node[j])
                        out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return confirm


def shingle_sets(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, n_shingles, keys), keys being sorted, of the texts of the ids (a written table)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.sort(shingles(t, WORDS).view(np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(k) for k in keys], pa.int64()), _list([k.view(np.uint64) for k in keys])], names=["id", "n_shingles", "keys"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small_side(ids), "id").select("id", "text")
    sets = texts.mapInArrow(read, "id long, n_shingles long, keys array<long>")
    return staged(sets.dropDuplicates(["id", "keys"]) if repeated else sets, "sets")


def confirmed_pairs(docs: DataFrame, pairs: DataFrame, similarity: float, repeated: bool) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are as similar as that."""
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = shingle_sets(docs, ids, repeated)
    a, b = (sets.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}")) for x in "ab")
    both = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= round(100 * similarity) * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def _with_components(member: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """member with the component of each id under the links, in buckets that hold several; and the components as links."""
    components = staged(connected_components(links), "components")
    held = staged(member.drop("component").join(components, "id", "left").withColumn("component", F.coalesce("component", "id")), "held")
    several = staged(held.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("key"), "several")
    stars = components.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return staged(held.join(several, "key").select("key", "id", "n", "least", "component"), "mixed"), stars


def confirmed_links(docs: DataFrame, first: DataFrame, similarity: float, repeated: bool = False) -> DataFrame:
    """(a, b): confirmed links whose closure is that of all candidate links between the rows of first.

    repeated says that some id has several rows.
    """
    member = staged(bucket_members(first), "members")
    pairs = staged(alike(member.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), first, similarity), "pairs")
    member, links = _with_components(member, confirmed_pairs(docs, pairs, similarity, repeated))
    if member.isEmpty():
        return links
    pairs = staged(alike(small_bucket_pairs(member).union(stray_pairs(member)), first, similarity), "pairs")
    links = links.union(staged(confirmed_pairs(docs, pairs, similarity, repeated), "links"))
    large = member.filter(F.col("n") > SMALL_BUCKET)
    if large.isEmpty():
        return links
    large, links = _with_components(large, links)
    if large.isEmpty():
        return links
    kinds = "key long, bi int, bj int, block int, id long, component long, n_shingles long, low_bits array<long>"
    matched = staged(block_rows(large, first).groupBy("key", "bi", "bj").applyInPandas(_matched(similarity), kinds), "matched")
    sets = shingle_sets(docs, staged(matched.select("id").distinct(), "ids"), repeated).select("id", "n_shingles", "keys")
    meeting = matched.join(sets, ["id", "n_shingles"])
    return links.union(meeting.groupBy("key", "bi", "bj").applyInPandas(_confirmed(similarity), "a long, b long"))


def near_duplicate_components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of non-blanks with A-Z in lower case, shingles five words (the whole sequence if shorter); two
    documents are linked if their sets' intersection is at least similarity of the union, components close the
    links, and the smallest id of each is kept. A text that is null or has no words has an empty set and is linked
    with nothing, so it keeps its own id. Rows of one id are one document, linked by any of its texts; all its
    rows carry the same decision. A null id names no document: component_id is null and kept is true. Texts of any
    length count whole: a task holds the shingles of one text, and of one block of a large bucket, at a time. Other
    columns are not read. The empty table gives no rows.
    """
    signed = staged(signatures(docs), "signatures")
    named = signed.filter("id is not null and n_shingles > 0")
    classes = staged(named.groupBy("digest_a", "digest_b", "n_shingles").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    first = staged(
        named.join(classes.select("digest_a", "digest_b", "n_shingles", "id"), ["digest_a", "digest_b", "n_shingles", "id"], "left_semi")
        .dropDuplicates(["id", "digest_a", "digest_b"])
        .select("id", "n_shingles", "low_bits", "bands"),
        "first",
    )
    repeated = not named.groupBy("id").count().filter("count > 1").isEmpty()
    links = confirmed_links(docs, first, similarity, repeated)
    copies = (
        named.select("digest_a", "digest_b", "n_shingles", F.col("id").alias("b"))
        .join(classes.filter("copies > 1").select("digest_a", "digest_b", "n_shingles", F.col("id").alias("a")), ["digest_a", "digest_b", "n_shingles"])
        .filter("a <> b")
        .select("a", "b")
    )
    components = staged(connected_components(links.union(copies)), "components")
    return (
        signed.select("id", "n_shingles")
        .join(components, "id", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that another document of their component stands for; of the rows of one id, one stays.

    Rows whose id is null stay. The columns are those of docs.
    """
    found = staged(near_duplicate_components(docs, similarity), "found")
    gone = staged(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    kept = docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    again = staged(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.limit(1).count():
        kept = kept.join(again, "doc_id", "left_anti").select(docs.columns).union(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


#: The same result by definition, for small tables: every pair that shares a shingle is compared.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end as sh
  from w),
e as (select doc_id, unnest(sh) as g, len(sh) as n from s),
common as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared
  from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from common where 100 * shared >= 75 * (na + nb - shared)),
near as (select a, b from links union all select b, a from links),
reach as (select a as x, a as y from near union select r.x, n.b from reach r join near n on r.y = n.a),
low as (select x, min(y) as m from reach group by x)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, coalesce(m, s.doc_id) as component_id, coalesce(m, s.doc_id) = s.doc_id as kept
from s left join low on x = s.doc_id
"""
