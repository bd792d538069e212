"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` of longs; component is the smallest node reachable.

    Each round sends every node to its neighbour of least scrambled id (or stays), joins the edges to that
    map and drops loops, so the graph shrinks by a constant factor a round whatever its shape. A node with
    a third of all edges costs one pre-aggregated row a task, and the joins are plain ones whose large
    partitions adaptive execution can split. Nothing but one row count a round reaches the driver.

    Nulls and loops are ignored; an empty table gives an empty one; repeated edges count once.
    """
    edges = saved(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    nodes = saved(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "nodes")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        step = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m")).select(F.col("a").alias("from"), F.col("m.id").alias("to"))
        step = saved(step, "step")
        edges = edges.join(step, edges.a == step["from"]).select(F.col("to").alias("a"), "b")
        edges = edges.join(step, edges.b == step["from"]).select("a", F.col("to").alias("b"))
        edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        moved = nodes.join(step, nodes.root == step["from"], "left")
        nodes = saved(moved.select("node", F.coalesce("to", "root").alias("root")), "nodes")
    least = saved(nodes.groupBy("root").agg(F.min("node").alias("component")), "least")
    return nodes.join(least, "root").select("node", "component")
