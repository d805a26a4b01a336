"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to smaller neighbours until every node points
at the smallest of its component. Only minima are aggregated, so a node with
many neighbours is folded before the shuffle; edges stay tables throughout and
each round is written to the shared folder.

Defined results: edges from a node to itself count for nothing, repeated and
reversed ones for one, edges with a null end are left out; without edges there
are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).where("x <> y")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").where("b <> low").select(F.col("b").alias("x"), F.col("low").alias("y"))
    return moved.unionByName(low.select(F.col("a").alias("x"), F.col("low").alias("y"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of whole numbers -> node, component for each node of an edge."""
    at = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        stars = written(_small_star(_large_star(at)), "stars").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # a set of edges that neither step changes is a set of stars
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        at, before = stars, now
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
