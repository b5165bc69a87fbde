"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypact.llm.common import discard, written


def _largest(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _smallest(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (moved.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then the smaller ends are the roots."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .filter("up > 1 or (up = 1 and down = 1)").isEmpty())


def roots(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any order -> (node, root): the least node of its component, for all nodes but roots.

    Every round is a table in the shared folder, and the one before is deleted. Rounds end when only stars are left;
    their number grows with the logarithm of the longest chain.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    while not _stars(now):
        before, now = now, written(_smallest(_largest(now)).distinct(), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
