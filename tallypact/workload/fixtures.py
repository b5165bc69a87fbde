"""Tables the queries share, derived from the domain views by the library's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallypact import views
from tallypact.functions.billing import period_months
from tallypact.plans import billing, finance, lifecycle
from tallypact.session import cut_lineage


def fleets(spark, d):
    return billing.fleet_sizes(views.engagements(spark, d), views.vehicles(spark, d))


def dues(spark, d):
    return billing.recurring_dues(views.pricing_terms(spark, d), fleets(spark, d))


def payments(spark, d):
    """Schedules of all engagements, four in five of the elapsed payments made."""
    rows = billing.generate_schedule(
        views.engagements(spark, d).join(dues(spark, d), "engagement_id"))
    paid = ((F.col("due_date") <= views.as_of())
            & ((F.col("engagement_id") + F.col("seq")) % 5 != 0))
    made = (F.col("monthly_recurring") * period_months(F.col("billing_frequency")))
    return rows.withColumn("paid", paid).withColumn(
        "amount_paid", F.when(F.col("paid"), made.cast("decimal(18,2)")))


def schedule(spark, d):
    return billing.with_status(payments(spark, d), views.as_of())


def portfolio(spark, d):
    """The portfolio table, one row per engagement, written once for the reports that share it."""
    return cut_lineage(finance.portfolio(
        views.engagements(spark, d), dues(spark, d),
        lifecycle.cycle_in_force(views.review_cycles(spark, d)), views.customers(spark, d),
        schedule(spark, d), views.as_of()), "portfolio")
