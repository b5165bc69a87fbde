"""Portfolio base and the finance reports derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import billing, lifecycle
from tallypact.operators.records import dimension
from tallypact.plans.billing import schedule_summary

MONEY = "decimal(18,2)"


def portfolio(engagements: DataFrame, dues: DataFrame, in_force: DataFrame,
              customers: DataFrame, schedule: DataFrame, as_of: Column) -> DataFrame:
    """One row per engagement with status, dues, term and receivables.

    Every input but ``customers`` is keyed by engagement, so one partitioning serves all joins.
    """
    receivables = schedule_summary(schedule)
    cycles = in_force.select("engagement_id", F.col("status").alias("cycle_status"))
    names = customers.select("customer_id", F.col("legal_name").alias("customer_name"))
    base = (engagements.join(dues, "engagement_id").join(cycles, "engagement_id", "left")
            .join(receivables, "engagement_id", "left").join(names, "customer_id", "left"))
    end = F.add_months("created_at", F.col("contract_term_months"))
    zero = F.lit(0)
    return base.select(
        "engagement_id", "customer_id",
        F.coalesce("customer_name", "client_name").alias("customer_name"),
        F.coalesce("cycle_status", "status").alias("status"), "created_at",
        "fleet_size", "monthly_recurring", end.alias("contract_end"),
        F.datediff(end, as_of).alias("days_to_expiry"),
        F.coalesce("paid_amount", zero).cast(MONEY).alias("collected_amount"),
        F.coalesce("paid_count", zero).alias("collected_count"),
        F.coalesce("outstanding_amount", zero).cast(MONEY).alias("outstanding_amount"),
        F.coalesce("overdue_count", zero).alias("overdue_count"),
        F.coalesce("overdue_amount", zero).cast(MONEY).alias("overdue_amount"))


def _is_active() -> Column:
    return F.col("status") == "ACTIVE"


def _sum(cond: Column, col: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast(MONEY)


def _all_keys(df: DataFrame, found: DataFrame, rows, key: str) -> DataFrame:
    """Every row of a fixed table, with zeros where nothing was found."""
    every = dimension(df.sparkSession, rows, f"{key} string, label string, position int")
    return every.join(found, key, "left").na.fill(0)


def ageing(schedule: DataFrame, as_of: Column, include_paid: bool = True) -> DataFrame:
    """Receivables by days past due; every bucket is present.

    Rows neither due nor overdue count as current. Paid rows are among them unless
    ``include_paid`` is off.
    """
    owed = F.col("status").isin("due", "overdue")
    bucket = F.when(owed, billing.bucket_of(F.datediff(as_of, "due_date"), fv.AGEING_BUCKETS)
                    ).otherwise("current")
    rows = schedule if include_paid else schedule.filter("status <> 'paid'")
    found = (rows.groupBy(bucket.alias("bucket"))
             .agg(F.count("*").alias("payments"), F.sum("amount").cast(MONEY).alias("amount")))
    keys = [(b[0], b[1], i) for i, b in enumerate(fv.AGEING_BUCKETS)]
    return _all_keys(schedule, found, keys, "bucket")


def revenue_trend(schedule: DataFrame, as_of: Column) -> DataFrame:
    """Billed and collected by due month, up to the month of ``as_of``."""
    month = F.date_format("due_date", "yyyy-MM")
    return (schedule.filter(F.trunc("due_date", "month") <= F.trunc(as_of, "month"))
            .groupBy(month.alias("month"))
            .agg(F.sum("amount").cast(MONEY).alias("billed"),
                 _sum(F.col("status") == "paid", "amount").alias("collected")))


def customer_rollup(base: DataFrame) -> DataFrame:
    """One customer's exposure across all their engagements."""
    live = _is_active()
    return base.groupBy("customer_id", "customer_name").agg(
        F.count("*").alias("engagements"), F.count_if(live).alias("active_engagements"),
        F.coalesce(F.sum(F.when(live, F.col("fleet_size"))), F.lit(0)).alias("fleet_size"),
        _sum(live, "monthly_recurring").alias("monthly_recurring"),
        F.sum("collected_amount").cast(MONEY).alias("collected_amount"),
        F.sum("outstanding_amount").cast(MONEY).alias("outstanding_amount"),
        F.sum("overdue_amount").cast(MONEY).alias("overdue_amount"),
        F.sum("overdue_count").alias("overdue_count"))


def with_share(rollup: DataFrame) -> DataFrame:
    """Annual value and share of the whole book; the book's total is one broadcast row."""
    book = (rollup.agg(F.sum("monthly_recurring").alias("book")).withColumn("k", F.lit(1)))
    return (rollup.withColumn("k", F.lit(1)).join(F.broadcast(book), "k").drop("k")
            .withColumn("annualized", (F.col("monthly_recurring") * 12).cast(MONEY))
            .withColumn("revenue_share",
                        billing.pct(F.col("monthly_recurring"), F.col("book"))).drop("book"))


def top(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """The n rows with the most of something; the key settles ties."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(key)).limit(n)


def totals(base: DataFrame, rollup: DataFrame) -> DataFrame:
    """The portfolio's headline figures in one row."""
    live = _is_active()
    soon = live & (F.col("days_to_expiry") <= fv.RENEWAL_DAYS)
    mrr = "monthly_recurring"
    of_base = base.agg(
        F.count("*").alias("engagements"), F.count_if(live).alias("active"),
        F.count_if(F.col("status") == "PENDING_BILLING_AUDIT").alias("awaiting_audit"),
        _sum(live, mrr).alias("monthly_recurring"),
        F.coalesce(F.sum(F.when(live, F.col("fleet_size"))), F.lit(0)).alias("total_fleet"),
        _sum(~live, mrr).alias("pipeline_value"),
        F.sum("collected_amount").alias("collected_amount"),
        F.sum("outstanding_amount").alias("outstanding_amount"),
        F.sum("overdue_count").alias("missed_count"),
        F.sum("overdue_amount").alias("missed_amount"),
        F.count_if(F.col("overdue_count") > 0).alias("missed_engagements"),
        F.count_if(soon).alias("expiring_90d"), _sum(soon, mrr).alias("expiring_90d_value"),
        F.count_if(live & (F.col("days_to_expiry") < 0)).alias("expired"))
    of_customers = rollup.agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("active_engagements") > 0).alias("active_customers"))
    of_top = top(rollup, mrr, "customer_id", 5).agg(F.sum(mrr).alias("top5"))
    parts = (of_base.unionByName(of_customers, allowMissingColumns=True)
             .unionByName(of_top, allowMissingColumns=True))
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    c = F.col
    return row.select(
        "engagements", "active", "awaiting_audit",
        (c("engagements") - c("active")).alias("in_pipeline"), "customers", "active_customers",
        "monthly_recurring", (c("monthly_recurring") * 12).alias("annualized"),
        billing.rounded_ratio(c("monthly_recurring"), c("active"), 2).alias("avg_per_engagement"),
        billing.rounded_ratio(c("monthly_recurring"), c("active_customers"), 2)
        .alias("avg_per_customer"),
        "total_fleet",
        billing.rounded_ratio(c("monthly_recurring"), c("total_fleet"), 2)
        .alias("revenue_per_vehicle"),
        "pipeline_value", "collected_amount", "outstanding_amount",
        billing.pct(c("collected_amount"), c("collected_amount") + c("outstanding_amount"))
        .alias("collection_rate"),
        "missed_count", "missed_amount", "missed_engagements",
        billing.pct(c("top5"), c("monthly_recurring")).alias("top5_revenue_share"),
        "expiring_90d", "expiring_90d_value", "expired")


def stage_funnel(base: DataFrame) -> DataFrame:
    """Engagements and recurring value in each of the six stages."""
    found = (base.groupBy(lifecycle.stage_of(F.col("status")).alias("stage"))
             .agg(F.count("*").alias("engagements"),
                  F.sum("monthly_recurring").cast(MONEY).alias("value")))
    keys = [(k, v[0], i) for i, (k, v) in enumerate(fv.STAGES.items())]
    return _all_keys(base, found, keys, "stage")


def expiry_buckets(base: DataFrame) -> DataFrame:
    """Live engagements by days to the end of their term; every bucket is present."""
    found = (base.filter(_is_active() & F.col("days_to_expiry").isNotNull())
             .groupBy(billing.bucket_of(F.col("days_to_expiry"), fv.EXPIRY_BUCKETS)
                      .alias("bucket"))
             .agg(F.count("*").alias("engagements"),
                  F.sum("monthly_recurring").cast(MONEY).alias("monthly_recurring")))
    keys = [(b[0], b[1], i) for i, b in enumerate(fv.EXPIRY_BUCKETS)]
    return _all_keys(base, found, keys, "bucket")


def engagement_order() -> list[Column]:
    """Overdue first, then live, then by value."""
    return [F.col("overdue_amount").desc(), (F.col("status") != "ACTIVE").asc(),
            F.col("monthly_recurring").desc_nulls_last(), F.col("engagement_id").asc()]


def dashboard(base: DataFrame, rollup: DataFrame, schedule: DataFrame, as_of: Column, n: int = 10) -> dict:
    """The thirteen reports of the finance page.

    ``base`` (:func:`portfolio`), its ``rollup`` (:func:`customer_rollup`) and ``schedule`` are read by several
    reports, so the caller passes written tables; nothing is cached here. Rankings keep ``n`` rows in every task
    before they meet, only contracts with a known end expire, and engagements are shown by :func:`engagement_order`.
    """
    live = base.filter(_is_active())
    customers = with_share(rollup)
    dated = live.filter(F.col("days_to_expiry").isNotNull())
    return {
        "totals": totals(base, rollup), "funnel": stage_funnel(base),
        "aging": ageing(schedule, as_of), "expiry_buckets": expiry_buckets(base),
        "revenue_trend": revenue_trend(schedule, as_of),
        "customers": customers, "engagements": base,
        "top_customers": top(customers, "monthly_recurring", "customer_id", n),
        "top_collected": top(customers, "collected_amount", "customer_id", n),
        "at_risk_customers": top(customers.filter("overdue_amount > 0"), "overdue_amount",
                                 "customer_id", n),
        "top_engagements": top(live, "monthly_recurring", "engagement_id", n),
        "recent_engagements": top(base, "created_at", "engagement_id", n),
        "expiring_contracts": dated.orderBy("days_to_expiry", "engagement_id").limit(n),
    }
