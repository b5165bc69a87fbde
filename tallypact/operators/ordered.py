"""Ordered work on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallypact.session import cut_lineage

CHUNK = 1024


def in_chunks(df: DataFrame, order: list[str], size: int, purpose: str) -> DataFrame:
    """Rows numbered into chunks of at most ``size`` in the given order.

    ``order`` starts with the key. Range partitioning cuts a hot key across many tasks, and the
    chunk number grows with the order. The numbering is written out, because it is read more than
    once and must not change between reads.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn(
        "chunk", F.floor(F.monotonically_increasing_id() / size)), purpose)


def with_next(df: DataFrame, key: str, order: list[str], column: str, out: str,
              size: int = CHUNK) -> DataFrame:
    """``column`` (never NULL) of the row that follows within the key, as ``out``.

    Inside a chunk the next row is a window over at most ``size`` rows. Only the heads of the
    chunks, fewer by that factor, are put in order per key to bridge one chunk to the next.
    """
    chunks = in_chunks(df, [key, *order], size, "next")
    heads = chunks.groupBy(key, "chunk").agg(
        F.min_by(column, F.struct(*order)).alias("head"))
    bridge = heads.select(key, "chunk", F.lead("head").over(
        Window.partitionBy(key).orderBy("chunk")).alias("next_head"))
    within = F.lead(column).over(Window.partitionBy(key, "chunk").orderBy(*order))
    return (chunks.withColumn(out, within).join(bridge, [key, "chunk"])
            .withColumn(out, F.coalesce(out, "next_head")).drop("chunk", "next_head"))


def with_position(df: DataFrame, key: str, order: list[str], out: str,
                  size: int = CHUNK) -> DataFrame:
    """The place of every row within its key, from 1, as ``out``.

    Rows are numbered inside chunks of at most ``size``; only the counts of the chunks are added
    up per key.
    """
    chunks = in_chunks(df, [key, *order], size, "position")
    counts = chunks.groupBy(key, "chunk").agg(F.count("*").alias("rows"))
    before = counts.select(key, "chunk", F.coalesce(F.sum("rows").over(
        Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(*order))
    same = F.col("c." + key).eqNullSafe(F.col("b." + key)) & (
        F.col("c.chunk") == F.col("b.chunk"))
    return (chunks.withColumn("within", within).alias("c").join(before.alias("b"), same)
            .select("c.*", (F.col("b.before") + F.col("c.within")).alias(out))
            .drop("chunk", "within"))
