"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.plans.scratch import drop_staged, staged


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which itself has none."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("lo", F.lit(0), F.lit(1))
    )
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of an edge table, component being the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round links nodes to the least
    id of their neighbourhood until the edges are stars. Minima are written before they are joined, so that
    a hub's rows meet in a join that AQE can split. Nulls are ignored; an edge of a node to itself keeps the
    node. Rounds grow with the logarithm of the diameter; the driver sees counts only.
    """
    given = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    current = staged(given.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    nodes = current.filter("hi = lo").select(F.col("hi").alias("id"))
    stars = current.filter("hi <> lo")
    old: list[DataFrame] = []
    for _ in range(max_rounds):
        if _is_star_forest(stars):
            break
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct(), "large"
        )
        least2 = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least2, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        new = staged(small.union(least2.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        for x in [least, large, least2, *old]:
            drop_staged(x)
        old, stars = [new], new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("lo").alias("id")).distinct()
    return (
        stars.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        .union(roots.select("id", F.col("id").alias("component")))
        .union(nodes.join(stars.select(F.col("hi").alias("id")).union(roots), "id", "left_anti").select("id", F.col("id").alias("component")))
    )
