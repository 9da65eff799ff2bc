"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.session import stage


def _written(least: DataFrame) -> DataFrame:
    """Written before it is joined: Spark splits the rows of a node with very many edges only between two
    plain shuffles, not beside the grouping itself."""
    return stage(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than the node hangs on the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = _written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return (both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("m").alias("a"), "b").filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours hang on the least of them. Edges hold a < b."""
    least = _written(edges.groupBy("b").agg(F.min("a").alias("m")))
    hung = edges.join(least, "b")
    return (hung.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
            .union(least.select(F.col("m").alias("a"), "b")).distinct())


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge. ``edges``: (a, b), in
    any order; loops and repeats do not matter. Sums stay in Spark: the driver sees a count and a
    checksum per round. Rounds grow with the logarithm of the longest path."""
    e = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        e = stage(_small_star(_large_star(e)), "edges")
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
