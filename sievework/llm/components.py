"""Connected components of an edge table, as joins: nothing is collected, lineage is cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge. Loops and repeats do no harm.

    Alternates large-star and small-star steps: a node links its larger neighbours to its smallest, then its smaller
    ones and itself to the smallest. Each step is a window-free group-by with a map-side minimum and one join, and the
    number of rounds grows with the logarithm of the largest component. A hot node's neighbours are never gathered:
    only its minimum is, and the join back to its edges is on a key that AQE may split.
    """
    e = materialise(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct(), "edges")
    while True:
        # Large star: edges seen from both ends; neighbours larger than the node go to the smallest of all.
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        large = materialise(large.filter("u < v").distinct(), "large-star")
        discard(e)
        # Small star: from the larger end; its smaller neighbours and itself go to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionAll(least.select(F.col("m").alias("u"), "v"))
        small = materialise(small.filter("u < v").distinct(), "small-star")
        discard(large)
        # Done when every edge is a star's: no node is both a centre and a leaf, and no leaf has two centres.
        split = small.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v").unionAll(small.select("v").join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))
        e = small
        if split.isEmpty():
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


class Forest:
    """Union-find over the members of a cell; union() says whether the edge joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def union(self, a: int, b: int) -> bool:
        up = self.up
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a == b:
            return False
        up[max(a, b)] = min(a, b)
        return True
