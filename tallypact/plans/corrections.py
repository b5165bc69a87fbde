"""A batch of corrections carried through all that depends on the corrected rows, and through nothing else.

Keys that a batch touches go on by semi join: a corrected wording is looked up in the catalog again, coverage is
rebuilt for document versions with a corrected line, and dues for engagements with an accepted override. Rows of other keys pass as
they are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.plans import billing, changes
from tallypact.plans.catalog import resolve
from tallypact.plans.terms import DOCUMENT, coverage
from tallypact.session import cut_lineage

FIELDS = ["program", "item", "amount"]
MATCH = ["program_id", "item_id", "catalog_match"]


def place_again(terms: DataFrame, corrections: DataFrame, programs: DataFrame, items: DataFrame,
                reads: list[str] | None = None) -> DataFrame:
    """Stored terms after corrections, with ``corrected``; a corrected pricing line has the match of its new wording.

    ``terms`` has term_key, category, ``FIELDS`` and ``MATCH``; ``corrections`` has term_key and ``FIELDS``, of which
    NULL ones keep what is stored. One correction a term. ``reads`` names the columns that the caller reads beside ``MATCH``;
    others that are not needed here are not written.
    """
    # Terms meet the corrections once; both kinds of rows are read back from there.
    every = changes.correct_terms(terms, corrections, "term_key", FIELDS)
    if reads is not None:
        every = every.select(*[c for c in every.columns if c in {*FIELDS, *MATCH, *reads, "category", "corrected"}])
    every = cut_lineage(every, "corrected")
    touched = every.filter("corrected")
    pricing = touched.filter("category = 'pricing'")
    placed = resolve(pricing.select(F.col("program").alias("program_raw"), F.col("item").alias("item_raw")), programs, items)
    same = F.col("t.program").eqNullSafe(F.col("p.program_raw")) & F.col("t.item").eqNullSafe(F.col("p.item_raw"))
    matched = pricing.drop(*MATCH).alias("t").join(placed.alias("p"), same, "left").select(
        "t.*", "p.program_id", "p.item_id", F.col("p.kind").alias("catalog_match"))
    return (every.filter("not corrected").unionByName(touched.filter("category <> 'pricing'")).unionByName(matched))


def rebuild_coverage(stored: DataFrame, terms: DataFrame) -> DataFrame:
    """Coverage after :func:`place_again`: rebuilt from live terms where a pricing line was corrected."""
    touched = terms.filter("corrected and category = 'pricing'").select(*DOCUMENT).distinct()
    fresh = coverage(terms.filter(~F.col("superseded")).join(touched, DOCUMENT, "left_semi"))
    return stored.join(touched, DOCUMENT, "left_anti").unionByName(fresh)


def decide_overrides(overrides: DataFrame, charges: DataFrame, statuses: DataFrame) -> DataFrame:
    """``overrides`` with ``refused``: NULL, or why the audit may not make this correction.

    ``overrides`` has engagement_id, term_key, new_amount and new_class; ``charges`` are the lines of the billing
    (engagement_id, record_id); ``statuses`` has engagement_id and status.
    """
    charged = charges.select("engagement_id", F.col("record_id").alias("term_key"), F.lit(True).alias("charged")).distinct()
    known = F.col("new_class").isNull() | F.col("new_class").isin(*fv.BASIS_FOR_CLASS)
    refused = (F.when(~F.col("status").eqNullSafe(F.lit("PENDING_BILLING_AUDIT")), "not under audit")
               .when(~known, "unknown class").when(F.col("charged").isNull(), "no such charge"))
    return (overrides.join(statuses.select("engagement_id", "status"), "engagement_id", "left")
            .join(charged, ["engagement_id", "term_key"], "left")
            .withColumn("refused", refused).drop("status", "charged"))


def override_terms(terms: DataFrame, accepted: DataFrame) -> DataFrame:
    """Terms to bill with accepted corrections beside their reading; a field that is not given keeps the one before."""
    fresh = accepted.select("term_key", "new_amount", "new_class")

    def merged(new: str, old: str) -> Column:
        return F.coalesce(new, old).alias(old)

    moved = {"override_amount": "new_amount", "override_class": "new_class"}
    return terms.join(fresh, "term_key", "left").select(
        *[merged(moved[c], c) if c in moved else c for c in terms.columns])


def rebill(stored: DataFrame, terms: DataFrame, accepted: DataFrame, in_force: DataFrame,
           fleets: DataFrame) -> DataFrame:
    """Dues of all engagements after accepted overrides, with ``rebilled``; others keep their stored row.

    ``stored`` has engagement_id, fleet_size and monthly_recurring. Lines are priced only for agreements of
    engagements with an accepted override.
    """
    touched = accepted.select("engagement_id").distinct()
    agreements = in_force.join(touched, "engagement_id", "left_semi")
    own = terms.join(agreements.select("document_id", "version").distinct(), ["document_id", "version"], "left_semi")
    lines = billing.config_lines(billing.billed_lines(override_terms(own, accepted)), agreements)
    fresh = billing.config_dues(lines, fleets.join(touched, "engagement_id", "left_semi"))
    return (stored.join(touched, "engagement_id", "left_anti").withColumn("rebilled", F.lit(False))
            .unionByName(fresh.withColumn("rebilled", F.lit(True))))
