"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node of ``edges`` (a, b of type long).

    A round links each neighbour to the smallest one, first upwards, then downwards, so the
    longest path shrinks geometrically. Nodes with many neighbours only ever meet in sums and
    joins that Spark can split. Self-links, repeated and reversed edges do no harm.
    """
    small = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(small(edges), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = small(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a")
        edges = stored(small(star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            star.select("a", F.col("m").alias("b")))), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
