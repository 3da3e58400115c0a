"""Near-duplicate vectors by collision-counting projections.

Every unit vector is projected on many random directions. A projection keeps, sorted, the vectors at its far ends,
where chance neighbours are rare: with TAIL_SCALE * sqrt(n) vectors in a list and as many lists as the recall asks
for, work grows as n ** 1.5 instead of n ** 2. Two vectors of a list collide if they lie in one another's
query-centred window. A pair is verified in double precision if it collides in at least the calibrated number of
lists, and belongs to the first list in which it collides, so it is counted once and no pair is written. Equal
vectors are one class that carries their number. Lists longer than a block meet block by block, so a group of near
copies does not end up in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.tables import limit_batches, table
from pointweave.operators.graph import connected_components
from pointweave.plans.scratch import small_side, staged

COSINE = 0.9
#: Share of pairs exactly at the cosine that are to be found; closer ones are found more surely.
RECALL = 0.995
#: Lists that a pair must share. Two cut chance pairs a hundredfold.
COLLISIONS = 2
TAIL_SCALE = 0.5
#: Window half-width in standard deviations of the difference of a pair at the cosine.
WINDOW_SIGMAS = 3.0
#: Rows of a block. A longer list meets block by block, and each of its vectors goes to all of them, so blocks are far longer
#: than most lists: those of 16 million vectors have as many rows as a block, those of 1 billion eight times as many.
BLOCK = 2048
#: Rows of a block that are counted against the others at a time, and bytes of vectors that are verified at a time.
CHUNK, VERIFIED_BYTES = 256, 4 << 20
#: Directions that are drawn at a time, and bytes of them that a task keeps; it draws those beyond again for each batch.
DRAWN, KEPT_BYTES = 512, 64 << 20
SEED = 8


def _normal_tail(t):
    return 0.5 * math.erfc(t / math.sqrt(2))


def tail_bound(share: float) -> float:
    """The value that a standard normal variable exceeds with this probability."""
    low, high = 0.0, 9.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _normal_tail(middle) > share else (low, middle)
    return low


def calibrate(n: int, dimensions: int, cosine: float = COSINE, recall: float = RECALL, collisions: int = COLLISIONS) -> tuple[int, float, float]:
    """(directions, bound, window): vectors whose projection is beyond the bound on either side are in its lists.

    A pair at the cosine that has one in a tail has the other there, within the window, with probability p, by
    the bivariate normal law, which Gaussian directions follow exactly in any number of dimensions (the argument
    changes nothing). Lists a vector is in are about Poisson; their mean is raised until a pair shares at least the
    needed number with the wanted recall.
    """
    share = min(0.05, TAIL_SCALE * math.sqrt(max(n, 1)) / max(n, 1))
    bound = tail_bound(share)
    rest = math.sqrt(1 - cosine * cosine)
    window = WINDOW_SIGMAS * math.sqrt(2 - 2 * cosine)
    x = np.linspace(bound, bound + 6, 4001)
    density = np.exp(-x * x / 2)
    low = np.maximum(bound, x - window)
    inside = np.array([_normal_tail((a - cosine * v) / rest) - _normal_tail((v + window - cosine * v) / rest) for a, v in zip(low, x)])
    p = float((density * inside).sum() / density.sum())
    mean = float(collisions)
    while 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(collisions)) < recall:
        mean += 0.05
    return math.ceil(mean / (p * 2 * share)), bound, window


def _drawn(block: int, count: int, dimensions: int) -> np.ndarray:
    """The rows of one block of DRAWN directions, of count in all."""
    return np.random.default_rng([SEED, block]).standard_normal((min(DRAWN, count - block * DRAWN), dimensions)).astype(np.float32)


def _directions(count: int, dimensions: int) -> np.ndarray:
    """Rows of independent normals, their lengths as drawn: projections of unit vectors are standard normal.

    Rows of one length would bound projections by sqrt(dimensions), with lighter tails.
    """
    return np.vstack([_drawn(b, count, dimensions) for b in range(-(-count // DRAWN))])


def _listed(calibrated: dict[int, tuple[int, float, float]]):
    """calibrated: (directions, bound, window) by the length of vectors."""
    made: dict[tuple[int, int], np.ndarray] = {}

    def directions(block: int, count: int, length: int) -> np.ndarray:
        found = made.get((block, length))
        if found is None:
            found = _drawn(block, count, length)
            if sum(m.nbytes for m in made.values()) + found.nbytes <= KEPT_BYTES:
                made[block, length] = found
        return found

    def place(batches):
        """Each vector with the lists it is in (2 * direction, + 1 for the lower end) and its place there."""
        for batch in batches:
            for length, rows in batch.groupby(batch["v"].map(len)):
                count, bound, _ = calibrated[length]
                for first in range(0, len(rows), 2048):
                    part = rows.iloc[first : first + 2048]
                    unit = np.vstack(part["v"].to_list()).astype(np.float64)
                    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
                    owner, lists, values = [], [], []
                    for block in range(-(-count // DRAWN)):
                        places = unit @ directions(block, count, length).T
                        for end, sign in ((0, 1), (1, -1)):
                            row, column = np.nonzero(sign * places >= bound)
                            owner.append(row)
                            lists.append(2 * (block * DRAWN + column) + end)
                            values.append(sign * places[row, column])
                    owner, lists, values = np.concatenate(owner), np.concatenate(lists).astype(np.int32), np.concatenate(values).astype(np.float32)
                    order = np.lexsort((lists, owner))
                    cuts = np.cumsum(np.bincount(owner, minlength=len(part)))[:-1]
                    yield part.assign(lists=np.split(lists[order], cuts), places=np.split(values[order], cuts))

    return place


def _joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """up, the least row that each row reaches, after the links i to j."""
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up[up] != up).any():
            up = up[up]


def _meet(cosine: float, calibrated: dict[int, tuple[int, float, float]], collisions: int):
    def meet(block: pd.DataFrame) -> pd.DataFrame:
        """Links that belong to this list: for each row how many, and the root that they reach.

        CHUNK rows are counted against all rows behind them at a time, so memory grows with the rows of the block, not
        with their pairs.
        """
        if len(block) == 1:
            return pd.DataFrame({"row_id": [], "reached": [], "links": []}, dtype=np.int64)
        block = block.sort_values(["place", "row_id"]).reset_index(drop=True)
        n, this = len(block), int(block["list"].iloc[0])
        window = calibrated[int(block["length"].iloc[0])][2]
        side = block["side"].to_numpy() if block["bi"].iloc[0] != block["bj"].iloc[0] else None
        owner = np.repeat(np.arange(n), [len(x) for x in block["lists"]])
        lists, places = np.concatenate(block["lists"].to_list()), np.concatenate(block["places"].to_list())
        order = np.argsort(lists, kind="stable")
        owner, lists, places = owner[order], lists[order], places[order]
        begins = np.flatnonzero(np.r_[True, np.diff(lists) > 0])
        ends = np.r_[begins[1:], len(lists)]
        group = np.repeat(np.arange(len(begins)), ends - begins)
        shared = np.flatnonzero((ends - begins)[group] > 1)
        shared = shared[np.argsort(owner[shared], kind="stable")]
        vectors = np.vstack(block["v"].to_list()).astype(np.float64)
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        copies, links, up = block["copies"].to_numpy(), np.zeros(n, np.int64), np.arange(n)
        step = max(1, VERIFIED_BYTES // (8 * vectors.shape[1]))
        for s in range(0, n, CHUNK):
            e = min(s + CHUNK, n)
            mine = shared[slice(*np.searchsorted(owner[shared], [s, e]))]
            count, first = np.zeros((e - s, n - s), np.int16), np.full((e - s, n - s), np.iinfo(np.int32).max, np.int32)
            for k in np.unique(group[mine]):
                who, at = owner[begins[k] : ends[k]], places[begins[k] : ends[k]]
                low, high = np.searchsorted(who, [s, e])
                near = np.abs(at[low:high, None] - at[None, low:]) <= window
                grid = np.ix_(who[low:high] - s, who[low:] - s)
                count[grid] += near
                first[grid] = np.where(near, np.minimum(first[grid], lists[begins[k]]), first[grid])
            i, j = np.nonzero(np.triu((count >= collisions) & (first == this), 1))
            i, j = i + s, j + s
            if side is not None:
                across = side[i] != side[j]
                i, j = i[across], j[across]
            for low in range(0, len(i), step):
                x, y = i[low : low + step], j[low : low + step]
                linked = (vectors[x] * vectors[y]).sum(axis=1) / (norm[x] * norm[y]) >= cosine
                x, y = x[linked], y[linked]
                up = _joined(up, x, y)
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
        ids = block["row_id"].to_numpy()
        out = pd.DataFrame({"row_id": ids, "reached": ids[up], "links": links})
        return out[out["links"] > 0]

    return meet


def near_vector_links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, collisions: int = COLLISIONS) -> DataFrame:
    """(row_id, reached, links) from different vectors (row_id, v, copies), non-zero and finite; only those of one length meet.

    links sums to the copies of other vectors linked with row_id; (row_id, reached) has the closure of the links.
    """
    limit_batches(vectors.sparkSession)
    lengths = vectors.groupBy(F.size("v").alias("length")).count().collect()  # one row a length, usually one
    calibrated = {r["length"]: calibrate(r["count"], r["length"], cosine, recall, collisions) for r in lengths}
    listed = staged(vectors.mapInPandas(_listed(calibrated), "row_id long, v array<double>, copies long, lists array<int>, places array<float>"), "listed").withColumn("length", F.size("v"))
    entries = listed.select("length", F.explode("lists").alias("list"))
    sizes = small_side(entries.groupBy("length", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "sizes")
    one = listed.select("row_id", "length", "v", "copies", "lists", "places", F.posexplode("lists").alias("at", "list"))
    meeting = (
        one.join(sizes, ["length", "list"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("side", F.pmod(F.xxhash64("row_id", "list"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("length", "list", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "row_id", F.col("places")[F.col("at")].alias("place"), "v", "copies", "lists", "places")
    )
    return meeting.groupBy("length", "list", "bi", "bj").applyInPandas(_meet(cosine, calibrated, collisions), "row_id long, reached long, links long")


def near_vector_components(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least the given one are linked, whatever their labels; components close the links
    and the smallest id of each is kept. A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, as does one of another length than its peers, or one whose id is null (component_id null,
    kept true). Equal vectors link like others, at no cost a pair; rows of one id and one vector count as one, and rows
    of one id with several vectors are one node. Other columns are not read; an empty table gives no rows.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("row_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(F.col("row_id").isNotNull() & F.col("v").isNotNull() & sound)
    greatest = F.array_max(F.transform("v", F.abs))
    scale = F.when(greatest.between(1e-100, 1e100), 1.0).otherwise(greatest)  # squares of others leave the range of doubles
    usable = staged(usable.select("row_id", F.transform("v", lambda x: x / scale).alias("v")).dropDuplicates(["row_id", "v"]), "vectors")
    grouped = usable.groupBy("v").agg(F.min("row_id").alias("first"), F.count("*").alias("copies"))
    classes = staged(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    found = staged(near_vector_links(classes.select(F.col("class").alias("row_id"), "v", "copies"), cosine, recall), "links")
    several = usable.join(classes.filter("copies > 1"), "v").select("class", "first", "row_id")
    members = staged(several.union(classes.filter("copies = 1").select("class", "first", "first")), "members")
    linked = found.groupBy(F.col("row_id").alias("class")).agg(F.sum("links").alias("links"))
    linked = classes.join(linked, "class", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).filter("links > 0")
    totals = members.join(linked, "class").groupBy(F.col("row_id").alias("vec_id")).agg(F.sum("links").cast("long").alias("n_links"))
    a, b = (classes.select(F.col("class").alias(c), F.col("first").alias(x)) for c, x in (("row_id", "a"), ("reached", "b")))
    edges = found.select("row_id", "reached").distinct().join(a, "row_id").join(b, "reached").select("a", "b")
    components = connected_components(edges.union(members.filter("first <> row_id").select("first", "row_id")))
    ids = rows.select(F.col("row_id").alias("vec_id"))
    return (
        ids.join(components.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .join(totals, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vector_components(table(spark, sf_dir, "embeddings"))


#: The same result by comparing every pair, for small tables.
SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from v),
near as (
  select a.vec_id as a, b.vec_id as b from u a join u b
  on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach as (select a as x, a as y from near union select r.x, n.b from reach r join near n on r.y = n.a),
low as (select x, min(y) as m from reach group by x),
links as (select a, count(*) as n from near group by a)
select e.vec_id, coalesce(n, 0) as n_links, coalesce(m, e.vec_id) as component_id, coalesce(m, e.vec_id) = e.vec_id as kept
from embeddings e left join low on x = e.vec_id left join links on a = e.vec_id
"""
