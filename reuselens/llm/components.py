"""Connected components by DataFrame operations only: alternating large-star and small-star rounds on staged edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import keyed_join, staged


def _stars(pairs: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Each neighbour v of a node u goes to u's least neighbour m. least: (u, m, d), d rows of ``pairs`` having u at most."""
    found = pairs.join(least.drop("d"), "u") if few else keyed_join(pairs, least, "u", "d")
    return found.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge, the least node reachable.

    Edges are undirected; loops, repeats and nulls are ignored (a node that has only loops is not returned). In each round
    a node's neighbours are reduced to their minimum before they are shuffled, and no neighbourhood is ever gathered: a
    hub with any number of edges is one row per edge, and these rows are not shuffled by the hub (``keyed_join``). Rounds: about the logarithm of the longest path. Each round is
    written to the shared folder, so neither its lineage nor a lost executor makes it run again.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = staged(e, "edges")
    n = e.count()
    while True:
        few = 2 * n <= common.HOT  # so no node is hot
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: neighbours above u go to the least of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.expr("v > u")).alias("d"))
        large = _stars(both.where("v > u"), least, few).distinct()
        # small star: u and its neighbours below it go to the least of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = _stars(down, low, few).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new = staged(small, "edges")
        # fixed when every node has one edge and no end is a start: stars around their minimum
        ends = new.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        if ends["n"] == ends["k"] and new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
        e, n = new, ends["n"]
    roots = new.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
