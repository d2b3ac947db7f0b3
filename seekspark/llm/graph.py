"""Connected components by contraction, as Spark joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the undirected edges; roots are nodes, one per component.

    Each round hooks every node to the neighbour (or itself) with the least hash, follows the hook once more and renames
    the edges' ends; edges inside a merged node vanish. Hashes change by round, so chains shrink by a constant factor as
    well. Aggregations combine before the shuffle: a node with very many neighbours is no hot task.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    roots = written(left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "roots")
    turn = 0
    while not left.isEmpty():
        order = F.xxhash64(F.lit(turn), "to")
        pairs = left.select("a", F.col("b").alias("to")).union(left.select(F.col("b").alias("a"), F.col("a").alias("to")))
        own = left.select("a").union(left.select("b")).distinct().select("a", F.col("a").alias("to"))
        hooks = pairs.union(own).groupBy("a").agg(F.min(F.struct(order.alias("h"), "to"))["to"].alias("to"))
        next_hop = hooks.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        hooks = written(hooks.join(next_hop, "to").select("a", F.col("beyond").alias("to")), "hooks")
        first, second = hooks.select("a", F.col("to").alias("x")), hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        left = written(left.join(first, "a").join(second, "b").filter("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        moved = roots.join(hooks.select(F.col("a").alias("root"), "to"), "root", "left")
        roots = written(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        turn += 1
    return roots


def joined(roots: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components (node, root) after further edges. Only the components' roots are followed, not their edges once more."""
    first, second = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(first, "a", "left").join(second, "b", "left")
    tops = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(moved.unionByName(tops.join(roots, "node", "left_anti")), "roots")
