"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.common import discard, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("b > a").union(edges.where("b > a").select("a", "b"))
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of every node of ``edges`` (a, b), as a stored table, and its path:
    component is the smallest node of those connected.

    Edges are a distributed table throughout. Each double step is written to the shared
    folder; a count and a hash sum show when nothing changes any more. A node of high degree
    is no hot task: minima are combined before the shuffle and the joins can be split."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, path = store(now, "edges")
    mark = None
    while True:  # each double step at least halves the depth of the trees that are left
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark or found["n"] == 0:
            break
        mark = (found["n"], found["h"])
        before = path
        now, path = store(_small_star(_large_star(now)), "edges")
        discard(spark, before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found, at = store(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component")), "components")
    discard(spark, path)
    return found, at
