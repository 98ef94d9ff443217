"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claraudit.llm.common import drop_path, stage_path, staged


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the edges (a[i], b[i])."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node that edges reach) for each node of edges (a long, b long). Each round aggregates by
    node with map-side combining; stars halve distances, so rounds grow with the logarithm of the longest path."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    work, spark = stage_path(edges.sparkSession, "edges"), edges.sparkSession
    e = staged(e, "edges", f"{work}/0")
    for i in range(rounds):
        # large star: every larger neighbour of u goes to u's smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges", f"{work}/{i + 1}")
        if new.exceptAll(e).isEmpty() and new.count() == e.count():
            break
        drop_path(spark, f"{work}/{i}")
        e = new
    else:
        raise RuntimeError(f"components: not at rest after {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    out = staged(roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop_path(spark, work)
    return out
