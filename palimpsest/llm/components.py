"""Connected components as DataFrame operations.

Each round contracts the graph: every node takes the neighbour within two hops that has the least priority (a hash
that changes from round to round, so that chains shrink geometrically), and edges are relabelled. Stars are done in
one round. Nothing but a row's own edges is ever needed at one place: minima are combined before the shuffle, and
joins on a hot node can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> one row (node, root) for every node with an edge to another one.

    Nodes are longs; direction, repeats, loops and null ends don't matter. The root is some node of the component,
    the same for all its nodes; callers that want the smallest id take a minimum over it. No edges: an empty result.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    graph = written(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels, k = None, 0
    while not graph.isEmpty():
        closed = graph.union(graph.select("a", "a").distinct().toDF("a", "b"))
        least = lambda c, k=k: F.min(F.struct(F.xxhash64(c, F.lit(k)).alias("p"), F.col(c).alias("n")))["n"]
        one = closed.groupBy("a").agg(least("b").alias("m"))
        two = closed.join(one.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(least("m").alias("to"))
        step = written(two.select(F.col("a").alias("node"), "to"), "step")
        moved = graph.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        graph = written(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), "edges")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            labels = labels.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        k += 1
    return labels if labels is not None else graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
