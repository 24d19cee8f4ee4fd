"""Connected components of an edge table, by alternating large-star and small-star steps.

Nothing of the graph comes to the driver but the number of edges that a step changed. Joins are on nodes; adaptive
execution splits what a star's centre gathers. Every round is written to the shared folder, so lineage ends there.

Defined results: edges in any direction, doubled edges and loops are allowed; null ends are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arpent.llm.common import drop, stored


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over stored edges (a, b) with a > b, whose files go."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # stored, so that the join has a plain exchange on both sides, which is what lets a centre's edges be split
    star = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = both.filter("b > a").join(star, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    after = stored(small.select("e.a", "e.b").filter("a > b").distinct(), "edges")
    drop(star)
    drop(edges)
    return after


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component for every node that has an edge to another; component is the smallest node it reaches."""
    a, b = F.col(left), F.col(right)
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, marks = stored(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == marks:
            break
        marks = tuple(now)
        edges = _star(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
