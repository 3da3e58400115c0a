"""Ranked lexical search by hashed max-sketches.

Every document keeps two rows of one-byte coordinates. A term falls on one coordinate of each row, by its hash, and
a coordinate holds the greatest occurrence count that fell on it. A document's impact of a term rises with the count,
so the folded count, put through the impact, is the folded impact whatever the corpus's totals are. The lesser of
a query term's two coordinates bounds its count from above, and the weighted sum bounds the score. Queries look all
their terms up in a batch of sketches at once. The documents with the greatest bounds are scored exactly first and
give each query its threshold; then every document whose bound reaches it is scored exactly, in descending bounds,
until no bound is as high as the last of the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.words import plain_words, word_hashes
from pointweave.plans.scratch import staged

LIMIT = 50
#: Coordinates of a row of a sketch for each distinct term of its document, and the fewest.
COORDINATES, LEAST_WIDTH = 4, 64
#: A coordinate with this count stands for it or any greater one.
MANY = 255
#: Queries of one pass over the sketches, by their number and their bytes; more queries take more passes.
ITEMS_A_PASS, ITEM_BYTES_A_PASS = 2048, 16 << 20
#: Cells (documents x query terms) that are looked up at a time.
CELLS = 2 << 20


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketch (2 x width) of a document's distinct terms; the width, a power of two, follows their number."""
    width = max(LEAST_WIDTH, 1 << max(COORDINATES * len(hashes) - 1, 1).bit_length())
    out = np.zeros((2, width), np.uint8)
    capped = np.minimum(counts, MANY).astype(np.uint8)
    for row, places in enumerate(_places(hashes, width)):
        np.maximum.at(out[row], places, capped)
    return out


def _places(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(width - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def indexed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sketch, terms, counts): a document's number of terms, its sketch, its distinct terms and their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches, terms, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = Counter(plain_words(text))
                each = np.fromiter(found.values(), np.int64, len(found))
                sizes.append(int(each.sum()))
                sketches.append(fold(word_hashes(list(found)), each).tobytes())
                terms.append(b" ".join(found))
                counts.append(each.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "sketch", "terms", "counts"]
            )

    return docs.select("doc_id", "text").mapInArrow(index, f"doc_id {kind}, n long, sketch binary, terms binary, counts binary")


def frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms, which are those of one pass's queries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                found.update(wanted.intersection(terms.split(b" ")))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    rows = index.select("terms").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in rows}


class Queries:
    """The queries of one pass: weighted terms, their hashes, and where each query's terms stand."""

    def __init__(self, items: dict[int, set[bytes]], frequency: dict[bytes, int], documents: int, length: int):
        self.documents, self.length = documents, max(length, 1)
        self.weight = {t: int(math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))) for t, df in frequency.items()}
        known = {i: [t for t in terms if t in self.weight] for i, terms in items.items()}
        self.items = [(i, terms) for i, terms in sorted(known.items()) if terms]
        vocabulary = sorted({t for _, terms in self.items for t in terms})
        at = {t: k for k, t in enumerate(vocabulary)}
        self.hashes = word_hashes(vocabulary)
        self.weights = np.array([self.weight[t] for t in vocabulary], np.int64)
        self.flat = np.array([at[t] for _, terms in self.items for t in terms], np.int64)
        self.starts = np.cumsum([0] + [len(terms) for _, terms in self.items])[:-1]

    def damping(self, n):
        """The part of the impact that a document of n terms has."""
        return 50 + (50 * n * self.documents) // self.length

    def bounds(self, sketches: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """(documents x queries): no score is greater."""
        out = np.zeros((len(sketches), len(self.items)), np.int64)
        widths = np.array([len(s) // 2 for s in sketches])
        step = max(1, CELLS // max(len(self.flat), 1))
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            places = _places(self.hashes, width)
            for first in range(0, len(rows), step):
                own = rows[first : first + step]
                stack = np.frombuffer(b"".join([sketches[i] for i in own]), np.uint8).reshape(len(own), 2, width)
                count = np.minimum(stack[:, 0, places[0]], stack[:, 1, places[1]])
                tf = np.arange(MANY + 1, dtype=np.int64)
                impacts = 1_000_000_000 * tf[None, :] // np.maximum(1000 * tf[None, :] + 20 * self.damping(sizes[own])[:, None], 1)
                impacts[:, MANY] = 1_000_000  # the limit of ever greater counts
                weighted = np.take_along_axis(impacts, count.astype(np.int64), 1) * self.weights
                out[own] = np.add.reduceat(weighted[:, self.flat], self.starts, axis=1)
        return out

    def score(self, query: int, counts: dict[bytes, int], n: int) -> int:
        m, total = self.damping(n), 0
        for t in self.items[query][1]:
            tf = counts.get(t, 0)
            if tf:
                total += self.weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        return total


def _counted(terms: bytes, counts: bytes) -> dict[bytes, int]:
    return dict(zip(terms.split(b" "), np.frombuffer(counts, np.int64).tolist()))


def _best_bounds(queries: Queries, limit: int):
    """Of a task's documents those with the limit greatest bounds, query by query."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, keys = np.zeros((0, len(queries.items)), np.int64), np.zeros((0, len(queries.items)), np.int64)
        for batch in batches:
            found = queries.bounds(batch.column(2).to_pylist(), batch.column(1).to_numpy())
            own = np.broadcast_to(batch.column(0).to_numpy()[:, None], found.shape)
            kept, keys = np.concatenate([kept, found]), np.concatenate([keys, own])
            if len(kept) > limit:
                top = np.argpartition(-kept, limit - 1, axis=0)[:limit]
                kept, keys = np.take_along_axis(kept, top, 0), np.take_along_axis(keys, top, 0)
        row, query = np.nonzero(kept > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(keys[row, query]), pa.array(kept[row, query])], names=["query", "row", "bound"])

    return best


def _scored(queries: Queries):
    """The exact scores of given pairs: rows are (n, terms, counts, queries of the document)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, scores = [], []
            for n, terms, counts, own in zip(*(c.to_pylist() for c in batch.columns)):
                held = _counted(terms, counts)
                asked += own
                scores += [queries.score(q, held, n) for q in own]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(scores, pa.int64())], names=["query", "score"])

    return scored


def _above(queries: Queries, thresholds: dict[int, int], limit: int, kind: pa.DataType):
    """Each query's best documents of a task, exactly: in descending bounds until none reaches the threshold."""

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array([max(thresholds.get(q, 0), 1) for q in range(len(queries.items))], np.int64)
        best: list[list[tuple]] = [[] for _ in queries.items]  # (-score, whether there is an id, id)
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            bounds, held = queries.bounds(batch.column(2).to_pylist(), sizes), {}
            reach = bounds >= least[None, :]
            for query in np.flatnonzero(reach.any(axis=0)).tolist():
                rows = np.flatnonzero(reach[:, query])
                for row in rows[np.argsort(-bounds[rows, query], kind="stable")].tolist():
                    if bounds[row, query] < least[query]:
                        break
                    if row not in held:
                        held[row] = _counted(batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
                    score = queries.score(query, held[row], int(sizes[row]))
                    if score >= least[query]:
                        best[query].append((-score, ids[row] is not None, ids[row]))
                        if len(best[query]) >= 2 * limit:
                            best[query] = sorted(best[query], key=lambda b: b[:2] + b[2:] * b[1])[:limit]
                            least[query] = max(least[query], -best[query][-1][0])
        found = [(q, b[2], -b[0]) for q, own in enumerate(best) for b in own]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=["query", "doc_id", "score"])

    return rescore


def searched(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0, the greater first, equal ones by id.

    The score is the contract's integer BM25 form. Every row of docs is a document and every row of items a query of
    its own, so repeated rows have ranks of their own and a repeated item_id repeats its ranks; null ids come first
    among equal scores. Null and empty texts have no terms; texts of any length are read whole. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    kind = docs.schema["doc_id"].dataType
    index = staged(indexed(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    documents, length = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = staged(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(count / ITEMS_A_PASS), math.ceil(size / ITEM_BYTES_A_PASS))
    found = None
    for number in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).select("item", "text").collect()  # a pass's, of bounded bytes
        terms = {r["item"]: set(plain_words(r["text"])) for r in own}
        queries = Queries(terms, frequencies(index, set().union(*terms.values())), documents, length)
        if not queries.items:
            continue
        seeds = index.select("row", "n", "sketch").mapInArrow(_best_bounds(queries, limit), "query long, row long, bound long")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "row"))
        seeds = staged(seeds.withColumn("_k", place).filter(F.col("_k") <= limit).groupBy("row").agg(F.collect_list("query").alias("queries")), "seeds")
        first = F.broadcast(seeds)  # at most limit rows a query of the pass
        exact = index.select("row", "n", "terms", "counts").join(first, "row").select("n", "terms", "counts", "queries").mapInArrow(_scored(queries), "query long, score long")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
        thresholds = {r["query"]: r["score"] for r in exact.withColumn("_k", place).filter(F.col("_k") == limit).collect()}  # a number a query
        above = _above(queries, thresholds, limit, to_arrow_type(kind))
        rows = index.select("doc_id", "n", "sketch", "terms", "counts").mapInArrow(above, f"query long, doc_id {kind.simpleString()}, score long")
        names = spark.createDataFrame(list(enumerate(i for i, _ in queries.items)), "query long, item long")
        rows = staged(rows.join(F.broadcast(names), "query").drop("query"), "scores")  # the pass's queries
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return items.select("item_id").limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: The same result by scoring every document that holds a term of an item.
SQL = f"""
with d as (select doc_id, row_number() over () as r, {_TERMS} as terms from documents),
t as (select doc_id, r, len(terms) as n, unnest(terms) as term from d),
s as (select count(distinct r) as docs, count(*) as length from t),
i as (select item_id, unnest(list_distinct({_TERMS})) as term from benchmark),
c as (select doc_id, r, n, term, count(*) as tf from t where term in (select term from i) group by all),
w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from c group by term), s),
p as (select item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) as bigint) as score
  from i join w using (term) join c using (term), s group by item_id, doc_id, r)
select item_id, cast(rank as int) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0) where rank <= 50
"""
