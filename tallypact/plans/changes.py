"""Batches of corrections, approvals, catalog edits and directory changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact.functions import terms as term_fn
from tallypact.functions.text import normalise_name, slugify
from tallypact.operators.records import last_by
from tallypact.session import cut_lineage
from tallypact.sources.batch_table import BatchTable


def apply_overrides(terms: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Audit corrections merged into the stored override, with a comment of what moved.

    ``patches`` has the key, patch_amount, patch_class, patch_by and patch_at; the term's own
    reading is left alone.
    """
    old = F.col("billing_override")
    touched = F.col("patch_amount").isNotNull() | F.col("patch_class").isNotNull()
    merged = F.when(touched, F.struct(
        F.coalesce("patch_amount", "billing_override.amount").alias("amount"),
        F.coalesce("patch_class", "billing_override.billing_class").alias("billing_class"),
        F.col("patch_by").alias("by"), F.col("patch_at").alias("at"))).otherwise(old)
    comment = term_fn.override_change(
        F.coalesce("billing_override.amount", "amount"), F.col("patch_amount"),
        F.col("billing_override.billing_class"), F.col("patch_class"))
    return (terms.join(patches, key, "left")
            .withColumn("change", comment).withColumn("billing_override", merged)
            .withColumn("corrected", touched)
            .drop("patch_amount", "patch_class", "patch_by", "patch_at"))


def approve_terms(terms: DataFrame, approvals: DataFrame) -> DataFrame:
    """Bulk approval by (document, version, category); a NULL category approves all of them."""
    by_category = approvals.filter("category is not null").select(
        "document_id", "version", "category").distinct().withColumn("hit", F.lit(True))
    by_document = approvals.filter("category is null").select(
        "document_id", "version").distinct().withColumn("hit_all", F.lit(True))
    asked = F.coalesce("hit", "hit_all", F.lit(False))
    newly = asked & ~F.col("superseded") & ~F.col("approved")
    return (terms.join(by_category, ["document_id", "version", "category"], "left")
            .join(by_document, ["document_id", "version"], "left")
            .withColumn("newly_approved", newly)
            .withColumn("approved", F.col("approved") | F.col("newly_approved"))
            .withColumn("needs_review", F.col("needs_review") & ~F.col("newly_approved"))
            .drop("hit", "hit_all"))


def correct_terms(terms: DataFrame, corrections: DataFrame, key: str,
                  fields: list[str]) -> DataFrame:
    """Field corrections: named fields take the correction where one is given."""
    patch = corrections.select(key, *[F.col(f).alias(f"new_{f}") for f in fields],
                               F.lit(True).alias("corrected_now"))
    out = terms.join(patch, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"new_{f}", f))
    return (out.withColumn("corrected", F.coalesce("corrected_now", F.lit(False)))
            .drop("corrected_now", *[f"new_{f}" for f in fields]))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last writer wins per key over a base table and a batch of changes."""
    values = [c for c in base.columns if c not in keys]
    both = (base.withColumn("_order", F.lit(None).cast("timestamp"))
            .unionByName(changes.withColumn("_order", order).select(*base.columns, "_order")))
    rank = F.coalesce("_order", F.lit("0001-01-01").cast("timestamp"))
    return last_by(both, keys, rank, values).select(*base.columns)


def upsert_into(table: BatchTable, number: int, batch: DataFrame, order: Column) -> None:
    """Batch ``number`` of changes written into a keyed table, last writer per key; a retry changes nothing.

    Files of buckets without a change stay as they are. ``order`` reads the batch, and rows stored before give way to it.
    """
    given = cut_lineage(batch.withColumn("_at", order), "upsert")
    table.merge(number, given, lambda old, new: upsert(old, new, table.key, F.col("_at")))


def add_aliases(programs: DataFrame, edits: DataFrame) -> DataFrame:
    """Catalog aliases after a batch of (program_id, alias) edits; names are never aliases."""
    fresh = (edits.withColumn("alias", F.trim("alias")).filter("alias <> ''").distinct()
             .groupBy("program_id").agg(F.collect_set("alias").alias("new_aliases")))
    merged = F.array_sort(F.array_distinct(F.concat(
        F.col("aliases"), F.array_except(
            F.coalesce("new_aliases", F.array().cast("array<string>")), F.array("name")))))
    return programs.join(fresh, "program_id", "left").withColumn(
        "aliases", merged).drop("new_aliases")


def close_unmatched(queue: DataFrame, edits: DataFrame) -> DataFrame:
    """The unmatched queue without the names that edits just placed."""
    placed = edits.select(normalise_name(F.col("alias")).alias("normalised")).distinct()
    return queue.join(placed, "normalised", "left_anti")


def promote(queue: DataFrame, promotions: DataFrame) -> DataFrame:
    """New programs from queued names; the queued wording stays as an alias when renamed."""
    name = F.trim(F.coalesce("new_name", "raw"))
    return queue.join(promotions, "normalised").select(
        slugify(name).alias("program_id"), name.alias("name"),
        F.when(F.col("raw") != name, F.array("raw"))
        .otherwise(F.array().cast("array<string>")).alias("aliases"))


def propagate_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """A person's new name and phone on every row that carries a copy."""
    fresh = profiles.select("user_id", F.col("name").alias("new_name"),
                            F.col("phone").alias("new_phone"))
    return (rows.join(fresh, "user_id", "left")
            .withColumn("name", F.coalesce("new_name", "name"))
            .withColumn("phone", F.coalesce("new_phone", "phone"))
            .drop("new_name", "new_phone"))
