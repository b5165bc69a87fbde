"""Change review between two readings, and the negotiation thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import billing as bill_fn
from tallypact.functions.binding import let
from tallypact.functions.text import normalise_name
from tallypact.operators.records import last_by
from tallypact.session import cut_lineage

READING = ["document_id", "version"]


def has_money() -> Column:
    """Whether a record states an amount, a rate, a minimum or tiers."""
    return (F.col("amount").isNotNull() | F.col("rate_pct").isNotNull()
            | F.col("minimum").isNotNull() | (F.coalesce(F.size("tier_bands"), F.lit(0)) > 0))


def priced_lines(terms: DataFrame) -> DataFrame:
    """Live priced lines as (reading, program key, display name, text of the line).

    Rows without money are left out. ``terms`` carries program, item, amount, rate_pct, fee_type,
    unit_basis, minimum and tier_bands.
    """
    line = bill_fn.fee_line(F.col("amount"), F.col("rate_pct"), F.col("fee_type"),
                            F.col("unit_basis"), F.col("minimum"), F.col("tier_bands"))
    key = let(normalise_name(F.col("program")), lambda k: F.when(k != "", k).otherwise(F.lower("program")))
    label = F.when(F.coalesce("item", F.lit("")) != "", normalise_name(F.col("item"))).otherwise("program")
    return (terms.filter(~F.col("superseded") & has_money())
            .select(*READING, key.alias("program_key"), "program",
                    F.concat(label, F.lit(": "), line).alias("line")))


def program_pricing(lines: DataFrame) -> DataFrame:
    """Per reading and program the priced lines in one text, sorted."""
    return lines.groupBy(*READING, "program_key").agg(
        F.min("program").alias("display"),
        F.array_join(F.array_sort(F.collect_list("line")), " ; ").alias("pricing"))


def changed_programs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Programs whose priced lines differ between a reading and the one it replaces.

    ``pairs`` comes from :func:`tallypact.plans.documents.predecessors`. Lines are compared as
    counted rows, and only programs that differ have their texts put together. Counted lines are written once: both sides
    read them, and both sides are read twice.
    """
    counted = cut_lineage(lines.groupBy(*READING, "program_key", "line").agg(
        F.count("*").alias("n"), F.min("program").alias("program")), "counted")
    new = (counted.join(pairs.select("document_id", F.col("current_version").alias("version")),
                        READING)
           .select("document_id", "program_key", "line", F.col("n").alias("new_n"),
                   F.col("program").alias("new_program")))
    old = (counted.join(pairs.select(
        F.col("document_id").alias("review_id"), F.col("previous_id").alias("document_id"),
        F.col("previous_version").alias("version")), READING)
        .select(F.col("review_id").alias("document_id"), "program_key", "line",
                F.col("n").alias("old_n"), F.col("program").alias("old_program")))
    both = new.join(old, ["document_id", "program_key", "line"], "full_outer")
    differ = (both.filter(~F.col("new_n").eqNullSafe(F.col("old_n")))
              .select("document_id", "program_key").distinct())
    texts = both.join(differ, ["document_id", "program_key"], "left_semi")

    def joined(count):
        repeated = F.flatten(F.collect_list(F.when(
            F.col(count) > 0, F.array_repeat("line", F.col(count).cast("int")))))
        text = F.array_join(F.array_sort(repeated), " ; ")
        return F.when(text == "", "(not present)").otherwise(text)

    return texts.groupBy("document_id", "program_key").agg(
        F.coalesce(F.min("new_program"), F.min("old_program")).alias("service"),
        joined("old_n").alias("before"), joined("new_n").alias("after"))


def reviews(in_force: DataFrame, pairs: DataFrame, requests: DataFrame) -> DataFrame:
    """Per engagement what its client asked for and the key a stored review is kept under.

    ``in_force`` has engagement_id, doc_type, document_id and version; ``requests`` engagement_id and requested. The
    key names both sides of every comparison and the request, so a change of either drops the stored review.
    Engagements none of whose agreements has an earlier reading are left out.
    """
    earlier = pairs.select("document_id", F.concat(
        F.lit("<"), F.col("previous_id").cast("string"), F.lit(":"),
        F.col("previous_version").cast("string")).alias("earlier"))
    side = F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col("version").cast("string"),
                    F.coalesce("earlier", F.lit("")))
    # An engagement has a slot per type, so at most two agreements are in force.
    signed = (in_force.join(earlier, "document_id", "left").groupBy("engagement_id")
              .agg(F.array_sort(F.collect_list(F.struct("doc_type", side.alias("side")))).alias("sides"),
                   F.count("earlier").alias("compared"))
              .filter("compared > 0"))
    asked = F.coalesce("requested", F.lit(""))
    key = F.concat(F.lit(f"v{fv.REVIEW_FORMAT}::"), F.array_join("sides.side", "|"), F.lit("::"),
                   F.substring(F.md5(asked), 1, 8))
    return signed.join(requests, "engagement_id", "left").select(
        "engagement_id", asked.alias("requested"), key.alias("cache_key"))


def review_items(in_force: DataFrame, pairs: DataFrame, requests: DataFrame, lines: DataFrame) -> DataFrame:
    """The changes that the reviews list, one row per program of an agreement in force."""
    live = in_force.select("engagement_id", "document_id", "doc_type")
    changes = changed_programs(pairs.join(live.select("document_id"), "document_id", "left_semi"), lines)
    return (changes.join(live, "document_id")
            .join(reviews(in_force, pairs, requests), "engagement_id")
            .select("engagement_id", "document_id", "doc_type", "cache_key", "service",
                    F.when(F.col("requested") != "", F.col("requested")).otherwise("—").alias("requested"),
                    F.concat("before", F.lit(" → "), "after").alias("delivered"), F.lit("new").alias("status")))


def latest_request(events: DataFrame) -> DataFrame:
    """The last comment a client left when asking for changes."""
    asked = events.filter("action = 'client_request_changes' and comment is not null")
    return last_by(asked, ["submission_id"], F.struct("ts", "event_id"), ["comment"]).select(
        "submission_id", F.col("comment").alias("requested"))


def thread(events: DataFrame, for_client: bool) -> DataFrame:
    """The steps of the negotiation; clients do not see internal ones."""
    shown = events.filter(F.col("action").isin(list(fv.THREAD_LABELS)))
    if for_client:
        shown = shown.filter(~F.col("action").isin(fv.INTERNAL_THREAD_ACTIONS))
    labels = F.create_map(*[F.lit(x) for kv in fv.THREAD_LABELS.items() for x in kv])
    return shown.withColumn("label", labels[F.col("action")])


def recap(thread_rows: DataFrame) -> DataFrame:
    """Number of steps and the most recent one, per submission, in words."""
    last = last_by(thread_rows, ["submission_id"], F.struct("ts", "event_id"),
                   ["label", "comment"])
    steps = thread_rows.groupBy("submission_id").agg(F.count("*").alias("steps"))
    quoted = F.when(F.coalesce("comment", F.lit("")) != "",
                    F.concat(F.lit(" — “"), "comment", F.lit("”"))).otherwise("")
    return steps.join(last, "submission_id").select(
        "submission_id", "steps", F.concat(
            F.col("steps").cast("string"), F.lit(" steps recorded. Most recent: "), "label",
            quoted, F.lit(".")).alias("summary"))
