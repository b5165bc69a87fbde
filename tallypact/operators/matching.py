"""One-to-one matching in a fixed order of choice, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypact.session import cut_lineage


def in_order_matches(edges: DataFrame, group: list[str]) -> DataFrame:
    """Each chooser in turn takes its best free candidate; all groups at once.

    ``edges`` has the group columns, ``chooser`` and ``candidate`` (ids that sort in order of
    choice and of preference among equals) and ``score``. Going through choosers one by one gives
    the only matching in which no chooser could have had a better candidate from a later one, so
    it is found in rounds: a pair is settled when the candidate is the chooser's best and no
    earlier chooser has an edge to it; settled choosers and candidates leave with all their edges.
    Edges shrink from round to round, and what is left of them is written out.
    """
    keys = [*group]
    remaining = cut_lineage(edges.select(*keys, "chooser", "candidate", "score"), "edges")
    settled = None
    while True:
        first = remaining.groupBy(*keys, "candidate").agg(F.min("chooser").alias("first"))
        pairs = cut_lineage(
            _best(remaining, keys).join(first, [*keys, "candidate"])
            .filter("first = chooser").drop("first"), "pairs")
        settled = pairs if settled is None else settled.unionByName(pairs)
        remaining = cut_lineage(
            remaining.join(pairs.select(*keys, "chooser"), [*keys, "chooser"], "left_anti")
            .join(pairs.select(*keys, "candidate"), [*keys, "candidate"], "left_anti"), "edges")
        if remaining.isEmpty():
            return settled


def _best(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each chooser's best candidate: highest score, then the candidate that sorts first."""
    order = F.struct((-F.col("score")).alias("s"), F.col("candidate").alias("c"))
    return edges.groupBy(*keys, "chooser").agg(
        F.min_by("candidate", order).alias("candidate"), F.max("score").alias("score"))
