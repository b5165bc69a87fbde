"""Fleet sizes, recurring dues, billing configurations and payment schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypact.functions import billing


def assigned_counts(vehicles: DataFrame) -> DataFrame:
    """Vehicles on each engagement; unassigned vehicles never reach the shuffle."""
    return (vehicles.filter(F.col("engagement_id").isNotNull())
            .groupBy("engagement_id").agg(F.count("*").alias("assigned")))


def fleet_sizes(engagements: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Engagements with the fleet they bill on: the override, else the vehicles assigned."""
    size = billing.effective_fleet(F.col("assigned"), F.col("fleet_size_override"))
    return (engagements.join(assigned_counts(vehicles), "engagement_id", "left")
            .withColumn("assigned", F.coalesce("assigned", F.lit(0)))
            .withColumn("fleet_size", size))


def recurring_dues(terms: DataFrame, fleets: DataFrame) -> DataFrame:
    """Monthly dues per engagement: live per-unit amounts plus the band of the fleet, x fleet.

    ``terms`` has engagement_id, frequency, amount, tier_bands and superseded. Flat amounts are
    summed first; only the few rows with bands need the fleet beside them.
    """
    live = terms.filter(~F.col("superseded")).withColumn(
        "unit_basis", billing.frequency_class(F.col("frequency")).unit_basis)
    flat = (live.filter(billing.enters_dues(F.col("unit_basis")))
            .groupBy("engagement_id").agg(F.sum("amount").alias("per_unit")))
    banded = None
    if "tier_bands" in terms.columns:
        banded = live.filter(F.size("tier_bands") > 0).select("engagement_id", "tier_bands")
    return _times_fleet(fleets, flat, banded)


def _times_fleet(fleets: DataFrame, flat: DataFrame, banded: DataFrame | None) -> DataFrame:
    """Dues of every fleet: per-unit sums, and the band each row of ``banded`` has for its size."""
    fleets = fleets.select("engagement_id", "fleet_size")
    out = fleets.join(flat, "engagement_id", "left")
    tiered = F.lit(0)
    if banded is not None:
        sums = (banded.join(fleets, "engagement_id").groupBy("engagement_id")
                .agg(F.sum(billing.tier_amount(F.col("tier_bands"), F.col("fleet_size")))
                     .alias("banded")))
        out = out.join(sums, "engagement_id", "left")
        tiered = F.coalesce("banded", F.lit(0))
    dues = ((F.coalesce("per_unit", F.lit(0)) + tiered)
            * F.col("fleet_size")).cast("decimal(18,2)")
    return out.select("engagement_id", "fleet_size",
                      F.when(F.col("fleet_size") > 0, dues).otherwise(F.lit(0))
                      .cast("decimal(18,2)").alias("monthly_recurring"))


def config_dues(lines: DataFrame, fleets: DataFrame) -> DataFrame:
    """Monthly dues per engagement from the fees of its billing (:func:`config_lines`).

    Fees count as billed, so an audit's corrected amount or class decides, and versions that are not in force add
    nothing. A fleet without lines owes nothing.
    """
    fees = lines.select("engagement_id", "fee.*")
    flat = (fees.filter(billing.enters_dues(F.col("unit_basis")))
            .groupBy("engagement_id").agg(F.sum("amount").alias("per_unit")))
    return _times_fleet(fleets, flat, fees.filter(F.size("tier_bands") > 0).select(
        "engagement_id", "tier_bands"))


def bill(engagements: DataFrame, lines: DataFrame, fleets: DataFrame,
         payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bills, schedule rows) of the given engagements; only their lines and fleets are read on.

    A bill has the number of charges and the dues. Schedules are made where ``payments`` has none yet.
    """
    ids = engagements.select("engagement_id").distinct()
    own = lines.join(ids, "engagement_id", "left_semi")
    charges = own.groupBy("engagement_id").agg(F.count("fee").alias("charges"))
    dues = config_dues(own, fleets.join(ids, "engagement_id", "left_semi"))
    bills = dues.join(charges, "engagement_id", "left").na.fill(0, ["charges"])
    return bills, new_schedules(engagements.join(dues, "engagement_id"), payments)


def generate_schedule(starts: DataFrame) -> DataFrame:
    """Schedule rows from billing_start and billing_frequency; generated without a shuffle."""
    months = billing.period_months(F.col("billing_frequency"))
    count = billing.schedule_length(F.col("billing_frequency"))
    rows = starts.withColumn("seq", F.explode(F.sequence(F.lit(0), count - 1)))
    due = F.add_months("billing_start", F.col("seq") * months)
    return (rows.withColumn("due_date", due)
            .withColumn("kind", F.when(F.col("seq") == 0, "initial").otherwise("recurring"))
            .withColumn("label", F.when(F.col("seq") == 0, "Initial payment").otherwise(
                billing.period_label(F.col("billing_frequency"), F.col("due_date")))))


def with_status(payments: DataFrame, as_of: Column) -> DataFrame:
    """Amount, status and payability of every payment of an engagement.

    The window holds one engagement's schedule, which the generator bounds at twelve rows.
    """
    per = Window.partitionBy("engagement_id")
    months = billing.period_months(F.col("billing_frequency"))
    period = F.round(F.coalesce("monthly_recurring", F.lit(0)) * months, 2).cast("decimal(18,2)")
    next_due = F.coalesce(F.lead("due_date").over(per.orderBy("seq")),
                          F.add_months("due_date", months))
    early = F.min(F.when(~F.col("paid") & (F.col("due_date") > as_of), F.col("seq"))).over(per)
    status = billing.schedule_status(F.col("paid"), F.col("due_date"), F.col("next_due"), as_of)
    return (payments.withColumn("next_due", next_due).withColumn("next_early", early)
            .withColumn("status", status)
            .withColumn("amount", F.when(F.col("paid"), F.col("amount_paid")).otherwise(period))
            .withColumn("pay_early", (F.col("status") == "upcoming")
                        & (F.col("seq") == F.col("next_early")))
            .withColumn("payable", F.col("status").isin("due", "overdue") | F.col("pay_early"))
            .drop("next_due", "next_early"))


def schedule_summary(schedule: DataFrame) -> DataFrame:
    """Overdue, paid and outstanding counts and amounts per engagement."""
    status, amount = F.col("status"), F.col("amount")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, amount)), F.lit(0)).cast("decimal(18,2)")

    return schedule.groupBy("engagement_id").agg(
        F.count_if(status == "overdue").alias("overdue_count"),
        total(status == "overdue").alias("overdue_amount"),
        F.count_if(status == "paid").alias("paid_count"),
        total(status == "paid").alias("paid_amount"),
        total(status.isin("due", "overdue")).alias("outstanding_amount"))


def new_schedules(engagements: DataFrame, payments: DataFrame) -> DataFrame:
    """Schedules for engagements that have none yet, so a rerun adds nothing."""
    have = payments.select("engagement_id").distinct()
    return generate_schedule(engagements.join(have, "engagement_id", "left_anti"))


def billed_lines(terms: DataFrame) -> DataFrame:
    """Live pricing terms as billed fees, with the way back to the clause.

    ``terms`` carries amount, rate_pct, frequency, tier_bands, override_amount, override_class.
    """
    fee = billing.fee_item(F.col("amount"), F.col("tier_bands"), F.col("rate_pct"),
                           billing.frequency_class(F.col("frequency")),
                           F.col("override_amount"), F.col("override_class"))
    return terms.filter(~F.col("superseded")).withColumn("fee", fee)


def service_lines(lines: DataFrame) -> DataFrame:
    """Per engagement and program: priced lines, their sum, and whether all are approved."""
    return lines.groupBy("engagement_id", "program").agg(
        F.count("fee").alias("fee_items"),
        F.sum("fee.amount").cast("decimal(18,2)").alias("amount"),
        F.bool_and("approved").alias("approved"))


def config_lines(lines: DataFrame, in_force: DataFrame) -> DataFrame:
    """Billed lines of the agreements in force, each with the clause it was read from.

    ``lines`` are :func:`billed_lines`; ``in_force`` has engagement_id, doc_type, document_id and
    version of the agreements that count. Lines of other versions are not billed.
    """
    terms = lines.drop("engagement_id")
    return (in_force.join(terms, ["document_id", "version"]).select(
        "engagement_id", "document_id", "version", "doc_type", F.col("term_key").alias("record_id"),
        "program", "item", "frequency", "fee", "approved", "confidence"))


def excluded_programs(engagements: DataFrame, programs: DataFrame, lines: DataFrame) -> DataFrame:
    """How many active programs an engagement's agreements do not name.

    Counted by subtraction: listing every absent program would be engagements x programs rows.
    """
    total = programs.agg(F.count_distinct("program").alias("total"))
    covered = (lines.join(programs, "program", "left_semi")
               .groupBy("engagement_id").agg(F.count_distinct("program").alias("covered")))
    one_row = total.withColumn("k", F.lit(1))
    return (engagements.select("engagement_id").join(covered, "engagement_id", "left")
            .withColumn("k", F.lit(1)).join(F.broadcast(one_row), "k")
            .select("engagement_id", F.coalesce("covered", F.lit(0)).alias("covered"),
                    (F.col("total") - F.coalesce("covered", F.lit(0))).alias("excluded")))


def config_documents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A billing configuration as a header row per engagement and its priced lines as rows.

    Lines stay rows at every size, so an engagement with a third of all lines is no giant document.
    """
    priced = lines.filter(F.col("fee").isNotNull())
    header = priced.groupBy("engagement_id").agg(
        F.count("*").alias("items"), F.sum("fee.amount").cast("decimal(18,2)").alias("amount"),
        F.bool_and("approved").alias("approved"))
    return header, priced.select("engagement_id", "term_key", "program", "item", "frequency",
                                 "fee", "approved")
