"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for each end of an edge (a, b): root is the least node of the component.

    Every step is joins and partial aggregates over edges, linear in them; a star around one node is
    split like any skewed join. The steps end when every node but the roots has one edge, to a root;
    that takes about log(n).
    """
    now = scratch.keep(edges.select("a", "b").filter("a <> b"))
    while True:
        # Large star: a node's larger neighbours are linked to its least one.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        down = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node keeps its least neighbour below and links the others to that.
        down = scratch.keep(down.distinct())
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        over = down.join(low, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = scratch.keep(low.select(F.col("u").alias("a"), F.col("m").alias("b")).union(over).distinct())
        scratch.drop(now, down)
        now = then
        above = now.select(F.col("b").alias("up")).distinct()
        state = now.join(above, F.col("a") == F.col("up"), "left").agg(F.count("a").alias("n"), F.count_distinct("a").alias("nodes"), F.count("up").alias("inner")).first()
        if state["n"] == state["nodes"] and not state["inner"]:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
