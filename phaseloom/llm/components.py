"""Connected components of a link table by repeated contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import hot_join, stored


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root): follow parents, which are smaller than their nodes, to the end by pointer jumping; hot roots are dealt."""
    at = stored(parents, "parents")
    while True:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = stored(hot_join(at, up, "root", F.col("node"), how="left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jump")
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            return at


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a, b): root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, if that is smaller, flattens the trees and contracts the
    links; what is left shrinks by half or more each time. Nodes with a large part of the links are dealt to several places. Links may repeat, in either direction, or be loops.
    """
    rest = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    loops = links.filter("a = b").select(F.col("a").alias("node"))
    roots = stored(rest.select(F.col("a").alias("node")).union(rest.select("b")).union(loops).distinct().withColumn("root", F.col("node")), "roots")
    while not rest.isEmpty():
        parents = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        flat = _flat(parents)
        to = flat.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = stored(hot_join(roots, to, "root", F.col("node"), how="left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        left, right = flat.select(F.col("node").alias("a"), F.col("root").alias("x")), flat.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = stored(hot_join(rest, left, "a", F.col("b"), how="left"), "moved")
        moved = hot_join(moved, right, "b", F.col("a"), how="left").select(F.coalesce("x", "a").alias("p"), F.coalesce("y", "b").alias("q"))
        rest = stored(moved.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
    return roots
