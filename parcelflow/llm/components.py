"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least node that links reach.

    A large star ties the larger neighbours of every node to its least neighbour, a small star the others; both are one
    aggregate and one join.  Rounds are written tables; their number grows with the logarithm of the longest chain.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "b > a")
        small = materialize(_star(large, None), "edges")
        left = edges.exceptAll(small).limit(1).count() + small.exceptAll(edges).limit(1).count()
        edges = small
        if left == 0:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _star(edges: DataFrame, keep: str | None) -> DataFrame:
    """Neighbours of every node tied to the least of them and itself; with ``keep`` only such neighbours."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = edges.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at"))
    if keep:
        tied = tied.filter(keep)
        made = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.filter("a != b").distinct()
