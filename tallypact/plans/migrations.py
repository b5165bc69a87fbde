"""One-off backfills: customers from client names, renames and duplicate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact.plans.documents import stored_slots


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def link_customers(engagements: DataFrame) -> DataFrame:
    """Engagements linked to a customer by client name, with today's fleet kept as override.

    The customer key is a digest of the name, so linking needs no join and a rerun changes
    nothing. Engagements without a client name are left out.
    """
    named = engagements.filter(F.coalesce(F.trim("client_name"), F.lit("")) != "")
    return named.withColumn("customer_key", F.sha1(name_key(F.col("client_name")))).withColumn(
        "fleet_size_override", F.coalesce("fleet_size_override", "fleet_size"))


def customers_from_names(linked: DataFrame) -> DataFrame:
    """The customers that :func:`link_customers` refers to, one per key."""
    return linked.groupBy("customer_key").agg(
        F.min_by(F.trim("client_name"), "engagement_id").alias("legal_name"))


def fill_slots(cycles: DataFrame) -> DataFrame:
    """Cycles with their slot map filled from the two older fields where it is empty; ``filled`` tells where that was.

    A filled map is kept, so a rerun changes nothing.
    """
    slots = stored_slots(F.col("document_ids"), F.col("msa_document_id"), F.col("mla_document_id"))
    bare = F.coalesce(F.size("document_ids"), F.lit(0)) <= 0
    return (cycles.withColumn("filled", bare & (F.size(slots) > 0)).withColumn("document_ids", slots))


def duplicate_customers(customers: DataFrame) -> DataFrame:
    """Names that more than one customer carries, ignoring case and outer spaces."""
    return (customers.groupBy(name_key(F.col("legal_name")).alias("name_key"))
            .agg(F.count("*").alias("customers"), F.min("customer_id").alias("first_id"))
            .filter("customers > 1"))


def rename_customers(engagements: DataFrame, renames: DataFrame) -> DataFrame:
    """The display copy of a customer's name on its engagements, after renames."""
    fresh = renames.select("customer_id", F.col("legal_name").alias("new_name"))
    return (engagements.join(fresh, "customer_id", "left")
            .withColumn("client_name", F.coalesce("new_name", "client_name")).drop("new_name"))
