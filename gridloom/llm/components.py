"""Connected components of a table of links, by alternating large and small stars.

Each round sends every node's larger neighbours, then all its neighbours, to the least one it
knows. Only minima by node meet in a group, never lists of neighbours, so hubs need no more memory than others.
Rounds are written to the shared folder; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import dropped, staged


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to its least neighbour, or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    moved = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of edges (a, b: long, a <> b, not null)."""
    spark = edges.sparkSession
    (edges, path), before = staged(edges.select("a", "b").distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        old, before = path, now
        edges, path = staged(_small(_large(edges)), "links")
        dropped(spark, old)
