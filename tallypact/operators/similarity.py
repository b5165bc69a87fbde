"""Sequence similarity of short names without comparing every pair."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_ratio(a: str, b: str) -> Column:
    """Twice the characters in matching blocks over the summed lengths.

    The function is nested so that it travels to the executors by value.
    """
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio()
                          for x, y in zip(left, right, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def _grams(key: Column) -> Column:
    """Two-letter pieces of a key, numbered by occurrence; short keys add their letters."""
    def numbered(pieces):
        return F.transform(pieces, lambda p, i: F.concat(
            p, F.lit("#"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda q: q == p))
            .cast("string")))

    size = F.length(key)
    pairs = F.when(size > 1, F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda i: F.substr(key, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    letters = F.when(size <= 4, F.split(key, "")).otherwise(F.array().cast("array<string>"))
    return F.concat(numbered(pairs), numbered(F.filter(letters, lambda c: c != "")))


def _shared_needed(total_length: Column, floor: float) -> Column:
    """Pieces two keys of this summed length share at least when their ratio reaches ``floor``.

    M matched letters lie in at most (lengths - 2M + 1) blocks, and a block of k letters holds
    k - 1 pieces, so at least 3M - lengths - 1 pieces are shared, with M >= floor * lengths / 2.
    """
    return F.greatest(F.lit(1), F.ceil(total_length * (1.5 * floor - 1) - 1 - 1e-9)).cast("int")


def close_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """All (scope, left_key, right_key, score) whose ratio may reach ``floor``.

    Both inputs have ``scope`` and ``key``, distinct. Only the rarest pieces of each key are
    joined: two keys that share t pieces must share one among the first n - t + 1 in any common
    order, so common pieces are almost never looked up. Nothing that reaches the floor is lost.
    """
    shortest_partner = floor / (2 - floor)

    lefts = left.withColumn("grams", _grams(F.col("key")))
    rights = right.withColumn("grams", _grams(F.col("key")))
    use = (lefts.select(F.explode("grams").alias("g"))
           .unionByName(rights.select(F.explode("grams").alias("g")))
           .groupBy("g").agg(F.count("*").alias("uses")))

    def rare(df, name):
        need = _shared_needed(F.length("key") * (1 + shortest_partner), floor)
        ranked = (df.select("scope", "key", F.explode("grams").alias("g")).join(use, "g")
                  .groupBy("scope", "key")
                  .agg(F.array_sort(F.collect_list(F.struct("uses", "g"))).alias("ranked")))
        # A key has about as many pieces as letters, so this list is as short as the key.
        kept = F.slice("ranked", F.lit(1),
                       F.greatest(F.size("ranked") - need + 1, F.lit(1)))
        return ranked.select("scope", F.col("key").alias(name), F.explode(kept.g).alias("g"))

    lengths = F.length("left_key") + F.length("right_key")
    longest_ratio = 2 * F.least(F.length("left_key"), F.length("right_key")) / lengths
    pairs = (rare(lefts, "left_key").join(rare(rights, "right_key"), ["scope", "g"])
             .filter(longest_ratio >= floor)
             .select("scope", "left_key", "right_key").distinct())
    both = (pairs
            .join(lefts.select("scope", F.col("key").alias("left_key"),
                               F.col("grams").alias("left_grams")), ["scope", "left_key"])
            .join(rights.select("scope", F.col("key").alias("right_key"),
                                F.col("grams").alias("right_grams")), ["scope", "right_key"]))
    shared = F.size(F.array_intersect("left_grams", "right_grams"))
    return (both.filter(shared >= _shared_needed(lengths, floor))
            .select("scope", "left_key", "right_key",
                    sequence_ratio("left_key", "right_key").alias("score"))
            .filter(F.col("score") >= floor))


def pruning_floor(accept: float, margin: float) -> float:
    """A runner-up below this can never block a match, so lower pairs need no score."""
    return math.floor((accept - margin) * 1000 - 1) / 1000
