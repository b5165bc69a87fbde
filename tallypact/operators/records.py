"""Set-level operators over extracted records and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import documents, terms

TIERS = "array<struct<min_units:int,max_units:int,amount:decimal(18,2)>>"
OVERRIDE = "struct<amount:decimal(18,2),billing_class:string,by:string,at:string>"


def band(low: Column, high: Column, amount: Column) -> Column:
    return F.struct(low.cast("int").alias("min_units"), high.cast("int").alias("max_units"),
                    amount.cast("decimal(18,2)").alias("amount"))


def dimension(spark, rows, schema: str) -> DataFrame:
    """A fixed table of a few rows (buckets, stages, routes); its size never grows with data.

    Built from literals, so the optimizer knows its size and keeps it in the JVM.
    """
    fields = [part.split() for part in schema.split(",")]
    literals = F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields, strict=True)])
        for row in rows])
    return spark.range(1).select(F.inline(literals))


def counts_by_category(records: DataFrame) -> DataFrame:
    """Record count of all four categories, zeros included."""
    counts = (records.select(terms.category_of(F.col("info_type")).alias("category"))
              .groupBy("category").agg(F.count("*").alias("records")))
    every = dimension(records.sparkSession, [(c,) for c in fv.CATEGORIES], "category string")
    return every.join(counts, "category", "left").na.fill(0, ["records"])


def scope_by_engagement(documents_: DataFrame) -> DataFrame:
    """What each engagement covers, from the types of the agreements given."""
    kind = F.col("doc_type")
    return (documents_.groupBy("engagement_id")
            .agg(F.bool_or(kind == "MLA").alias("has_lease"),
                 F.bool_or(kind == "MSA").alias("has_service"))
            .select("engagement_id",
                    documents.scope_of(F.col("has_lease"), F.col("has_service")).alias("scope"),
                    F.filter(F.array(F.when(F.col("has_lease"), "MLA"),
                                     F.when(F.col("has_service"), "MSA")),
                             lambda t: t.isNotNull()).alias("present")))


def first_by(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """One row per key: the values of the row with the smallest ``order``.

    An aggregate, so a hot key is reduced in every map task before anything is shuffled.
    """
    packed = F.struct(*[F.col(v) for v in values])
    return (df.groupBy(*keys).agg(F.min_by(packed, order).alias("_first"))
            .select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values]))


def last_by(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest ``order``."""
    packed = F.struct(*[F.col(v) for v in values])
    return (df.groupBy(*keys).agg(F.max_by(packed, order).alias("_last"))
            .select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values]))
