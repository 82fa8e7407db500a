"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import dropped, keyed_join, written


def _nodes(edges: DataFrame) -> DataFrame:
    """For each node: its smallest parent, how many parents and how many children it has."""
    both = edges.select(F.col("child").alias("node"), "parent", F.lit(1).alias("up"), F.lit(0).alias("down"))
    both = both.unionByName(edges.select(F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return both.groupBy("node").agg(F.min("parent").alias("least"), F.sum("up").alias("up"), F.sum("down").alias("down"))


def components(edges: DataFrame) -> DataFrame:
    """Stars (child, parent) of edges(child, parent) with child > parent: every node but the smallest of its component, with the smallest.

    Each round replaces links by links to smaller nodes; rounds grow with the logarithm of a component's diameter.
    """
    edges = written(edges.where("child > parent").distinct(), "links")
    while True:
        nodes = written(_nodes(edges), "nodes")
        if nodes.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            dropped(nodes)
            return edges
        ups = nodes.where("down > 0").select(F.col("node").alias("parent"), "least", F.col("down").alias("rows"))
        large = keyed_join(edges, ups, ["parent"], "rows", F.col("child"))
        large = written(large.select("child", F.coalesce("least", "parent").alias("parent")).distinct(), "large-stars")
        downs = written(large.groupBy("child").agg(F.min("parent").alias("least"), F.count("*").alias("rows")), "least-parents")
        small = keyed_join(large, downs, ["child"], "rows", F.col("parent"))
        pairs = F.when(F.col("parent") == F.col("least"), F.array(F.struct("child", F.col("least").alias("parent")))).otherwise(
            F.array(F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")), F.struct("child", F.col("least").alias("parent")))
        )
        old, edges = edges, written(small.select(F.inline(pairs)).where("child > parent").distinct(), "small-stars")
        dropped(old, nodes, large, downs)
