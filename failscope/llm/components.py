"""Connected components of an edge list by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import counted, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (x, y: long): root is its component's least node.

    In every round each node joins its neighbour (or itself) of the least hash, which differs from
    round to round, and the edges' ends are renamed. On a path, whatever the order of its ids,
    about a third of the nodes remain, so the number of rounds is logarithmic. A hub's
    rows are pre-aggregated before the shuffle. Every round is written to the shared folder.
    """
    edges, rows = counted(edges.where("x != y").select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    turn = 0
    while rows:
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c).alias("node"))  # noqa: B023, E731
        least = saved(both.groupBy("x").agg(F.min(order("y")).alias("best")).select(
            F.col("x").alias("node"), F.least(order("x"), F.col("best"))["node"].alias("to")), "hooks")
        roots = saved(roots.join(least.select(F.col("node").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "roots")
        moved = edges.join(least.select(F.col("node").alias("x"), F.col("to").alias("x2")), "x").join(
            least.select(F.col("node").alias("y"), F.col("to").alias("y2")), "y")
        edges, rows = counted(moved.where("x2 != y2").select(
            F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")).distinct(), "edges")
        turn += 1
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return saved(roots.join(least, "root").select("node", F.col("least").alias("root")), "components")
