"""Connected components of a graph in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.tables import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)`` (long): the smallest node it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least of
    them, until every node hangs on the least of its component: a number of rounds that
    grows with the logarithm of the nodes. Least neighbours are combined before their
    shuffle and joined back to the edges, so that a node with very many edges is split by
    adaptive execution. Loops are ignored; an empty table has no nodes.
    """
    edges = written(_down(edges.where(F.col("a") != F.col("b"))).distinct(), "edges")
    while _unsettled(edges):
        large = _star(_both(edges), lambda a, b: b > a)
        small = _star(_down(large), lambda a, b: b < a).distinct()
        spent, edges = edges, written(small, "edges")
        dropped(spent)
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Each edge from its larger end to its smaller one."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, moved) -> DataFrame:
    """For each node ``a``, edges from itself and the ``moved`` neighbours to the least of them all."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    hung = joined.where(moved(F.col("a"), F.col("b"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return hung.unionAll(own).where(F.col("a") != F.col("b"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that hangs on a third; each node's ends are counted in one shuffle."""
    end = lambda c, hangs: edges.select(F.col(c).alias("node"), F.lit(hangs).alias("hangs"), F.lit(1 - hangs).alias("holds"))
    ends = end("a", 1).unionAll(end("b", 0)).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not ends.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()
