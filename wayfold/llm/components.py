"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the least node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter(F.col("a") != F.col("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node that can be reached.

    Edges are undirected; loops and repeated edges don't matter, rows with a null end are left out. Each
    round shrinks paths by half or better and writes its edges to the shared folder; no node's neighbours
    are gathered, only their minimum is.
    """
    # a round reads its edges many times over: from a table, so that its plan doesn't hold theirs as often
    now = materialize(edges.filter(F.col("a") != F.col("b")).select(F.col("a"), F.col("b")).distinct(), "edges")
    state = None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
