"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.operators.skew import join_unique
from curate.storage import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(rows: DataFrame) -> DataFrame:
    """The least of each node and its neighbours; the aggregate combines a hot node's rows before the shuffle."""
    return rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least of node and neighbours."""
    rows = _both(edges)
    joined = join_unique(rows.where("b > a"), _least(rows), "a", "inner")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the least of them. Here b < a in every edge."""
    joined = join_unique(edges, _least(edges), "a", "inner")
    to = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return to.where("a != b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, root) of every node that is not the least of its component.

    ``edges`` has two columns a and b of one ordered type, in any direction; loops and repeats are ignored.
    Every round is a staged table, so a lost executor costs one round; the number of rounds grows with the
    logarithm of the longest path. Nothing but a count and a checksum comes to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = stage(edges, name)
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.withColumnRenamed("b", "root")
        seen = mark
        edges = stage(_small_star(_large_star(edges)), name)
