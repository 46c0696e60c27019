"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.session import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller and equal) neighbours of each node to its smallest one."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(turned) if larger else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select("b", "m", "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` of every node of ``edges(a, b)``; the id is the smallest node.

    Each round stores the contracted edges; rounds grow with the logarithm of a component's size.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    last = None
    while True:
        large = stored(_star(edges, True), "large")
        edges = stored(_star(large, False), "small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    nodes = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    roots = edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component_id")).distinct()
    return nodes.unionByName(roots)
