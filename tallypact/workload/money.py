"""Finance, billing and schedule queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact import views
from tallypact.functions import billing as bill_fn
from tallypact.operators.records import TIERS, band
from tallypact.plans import billing, finance, lifecycle, payments
from tallypact.session import cut_lineage
from tallypact.views import AS_OF, as_of
from tallypact.workload import fixtures as fx
from tallypact.workload import oracle_views as ov
from tallypact.workload.oracle_views import PORTFOLIO, SCHEDULE
from tallypact.workload.registry import query

DAY = f"DATE '{AS_OF}'"
DUES = "engagements vehicles pricing_terms priced_terms fleet_sizes dues"


def doubles(df, *cols):
    """Money leaves as DOUBLE once all sums are done."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


def d(x: str) -> str:
    return f"cast({x} as double) as {x}"


# --- joins of the portfolio ------------------------------------------------------------------
@query("D1_cycle_in_force_join", uses="engagements review_cycles cycle_in_force", sql="""
select e.engagement_id, s.submission_id, coalesce(s.status, e.status) as status
from engagements e left join cycle_in_force s on e.engagement_id = s.engagement_id""")
def cycle_in_force_join(spark, sf):
    cycles = lifecycle.cycle_in_force(views.review_cycles(spark, sf)).select(
        "engagement_id", "submission_id", F.col("status").alias("cycle_status"))
    return (views.engagements(spark, sf).join(cycles, "engagement_id", "left")
            .select("engagement_id", "submission_id",
                    F.coalesce("cycle_status", "status").alias("status")))


@query("D2_customer_names", uses="customers engagements", sql="""
select engagement_id, coalesce(legal_name, client_name) as customer_name from engagements e
left join (select case when customer_id % 3 = 0 then -customer_id else customer_id end as id,
  legal_name from customers) c on e.customer_id = c.id""")
def customer_names(spark, sf):
    # A third of the customers are on file under another number.
    number = F.when(F.col("customer_id") % 3 == 0, -F.col("customer_id")).otherwise(
        F.col("customer_id"))
    known = views.customers(spark, sf).select(number.alias("customer_id"), "legal_name")
    return (views.engagements(spark, sf).join(known, "customer_id", "left")
            .select("engagement_id",
                    F.coalesce("legal_name", "client_name").alias("customer_name")))


@query("D3_engagement_payments", uses=SCHEDULE, sql=f"""
select e.engagement_id, s.seq, strftime(s.due_date, '%Y-%m-%d') as due_date, {d('amount')}
from engagements e left join schedule s
on e.engagement_id = case when s.engagement_id % 4 = 0 then -s.engagement_id
  else s.engagement_id end""")
def engagement_payments(spark, sf):
    # A quarter of the schedules belong to engagements that are not there.
    owner = F.when(F.col("engagement_id") % 4 == 0, -F.col("engagement_id")).otherwise(
        F.col("engagement_id"))
    rows = fx.schedule(spark, sf).select(
        owner.alias("engagement_id"), "seq", F.col("due_date").cast("string"),
        F.col("amount").cast("double"))
    return views.engagements(spark, sf).select("engagement_id").join(
        rows, "engagement_id", "left")


SQL_BAND = """case when fleet_size between 1 and lo then a1 when fleet_size between lo + 1 and
  lo * 3 then a2 when fleet_size > lo * 3 then a3 end"""
ov.VIEWS["banded"] = """select engagement_id as eid, case when l_suppkey % 5 = 0 then
  cast(1 + l_suppkey % 20 as int) end as lo,
  amount as a1, cast(amount / 2 as decimal(18,2)) as a2, rate_pct as a3, term_key
  from pricing_terms"""


def banded_terms(spark, sf):
    """All terms; every fifth supplier prices by fleet band."""
    terms = views.pricing_terms(spark, sf)
    low = (1 + F.col("l_suppkey") % 20).cast("int")
    half = (F.col("amount") / 2).cast("decimal(18,2)")
    return terms.withColumn("tier_bands", F.when(F.col("l_suppkey") % 5 == 0, F.array(
        band(F.lit(1), low, F.col("amount")), band(low + 1, low * 3, half),
        band(low * 3 + 1, F.lit(None), F.col("rate_pct"))).cast(TIERS)).otherwise(
            F.array().cast(TIERS)))


@query("D8_tier_band_match", uses=f"{DUES} banded", sql=f"""
select term_key, fleet_size, cast({SQL_BAND} as double) as band_amount
from banded join fleet_sizes f on eid = f.engagement_id""")
def tier_band_match(spark, sf):
    sizes = fx.fleets(spark, sf).select("engagement_id", "fleet_size")
    return (banded_terms(spark, sf).join(sizes, "engagement_id")
            .select("term_key", "fleet_size", bill_fn.tier_amount(
                F.col("tier_bands"), F.col("fleet_size")).cast("double").alias("band_amount")))


def bucket_sql(days: str, buckets) -> str:
    arms = " ".join(f"when {days} <= {b[3]} then '{b[0]}'" for b in buckets if b[3] is not None)
    return f"case {arms} else '{buckets[-1][0]}' end"


@query("D9_day_buckets", uses=PORTFOLIO, sql=f"""
select 'ageing' as kind, {bucket_sql(f"date_diff('day', due_date, {DAY})", fv.AGEING_BUCKETS)}
  as bucket, count(*) as n from schedule where status in ('due', 'overdue') group by all
union all
select 'expiry', {bucket_sql('days_to_expiry', fv.EXPIRY_BUCKETS)}, count(*) from portfolio
group by all""")
def day_buckets(spark, sf):
    late = F.datediff(as_of(), "due_date")
    ages = (fx.schedule(spark, sf).filter("status in ('due', 'overdue')")
            .groupBy(F.lit("ageing").alias("kind"),
                     bill_fn.bucket_of(late, fv.AGEING_BUCKETS).alias("bucket"))
            .agg(F.count("*").alias("n")))
    end = bill_fn.contract_end(F.lit(None).cast("date"), F.col("created_at"),
                               F.col("contract_term_months"))
    left = (views.engagements(spark, sf)
            .groupBy(F.lit("expiry").alias("kind"),
                     bill_fn.bucket_of(F.datediff(end, as_of()), fv.EXPIRY_BUCKETS)
                     .alias("bucket"))
            .agg(F.count("*").alias("n")))
    return ages.unionByName(left)


# --- dues and schedules ----------------------------------------------------------------------
@query("E3_recurring_dues", uses=f"{DUES} banded", sql=f"""
select f.engagement_id, f.fleet_size, cast(cast((coalesce(p, 0) + coalesce(b, 0)) * f.fleet_size
  as decimal(18,2)) as double) as monthly_recurring from fleet_sizes f
left join (select engagement_id as eid, sum(amount) as p from priced_terms
  where not superseded and regexp_matches(unit_basis, 'per_(vehicle|unit).*month')
  group by all) t on f.engagement_id = t.eid
left join (select b.eid, sum({SQL_BAND}) as b from banded b join pricing_terms t
  on t.term_key = b.term_key and t.l_suppkey % 5 = 0 join fleet_sizes z
  on z.engagement_id = b.eid where not superseded group by all) x on f.engagement_id = x.eid""")
def recurring_dues(spark, sf):
    flat = views.pricing_terms(spark, sf).withColumn("tier_bands", F.lit(None).cast(TIERS))
    keys = ["engagement_id", "frequency", "amount", "superseded", "tier_bands"]
    extra = banded_terms(spark, sf).withColumn("frequency", F.lit("bundled"))
    terms = flat.select(*keys).unionByName(extra.select(*keys))
    return doubles(billing.recurring_dues(terms, fx.fleets(spark, sf)), "monthly_recurring")


@query("E4_schedule_summary", uses=SCHEDULE, sql="""
select engagement_id, count(*) filter (where status = 'overdue') as overdue_count,
  cast(sum(case when status = 'overdue' then amount else 0 end) as double) as overdue_amount,
  count(*) filter (where status = 'paid') as paid_count,
  cast(sum(case when status = 'paid' then amount else 0 end) as double) as paid_amount
from schedule group by engagement_id""")
def schedule_summary(spark, sf):
    out = billing.schedule_summary(fx.schedule(spark, sf)).drop("outstanding_amount")
    return doubles(out, "overdue_amount", "paid_amount")


SQL_AGE = bucket_sql(f"date_diff('day', due_date, {DAY})", fv.AGEING_BUCKETS)
BUCKET_ROWS = ", ".join(f"('{b[0]}', '{b[1]}')" for b in fv.AGEING_BUCKETS)
EXPIRY_ROWS = ", ".join(f"('{b[0]}', '{b[1]}')" for b in fv.EXPIRY_BUCKETS)
STAGE_ROWS = ", ".join(f"('{k}', '{v[0]}')" for k, v in fv.STAGES.items())


@query("E5_ageing_buckets", uses=SCHEDULE, sql=f"""
select b.bucket, b.label, coalesce(payments, 0) as payments,
  cast(coalesce(amount, 0) as double) as amount
from (values {BUCKET_ROWS}) b(bucket, label) left join (
  select case when status in ('due', 'overdue') then {SQL_AGE} else 'current' end as bucket,
  count(*) as payments, sum(amount) as amount from schedule group by 1) s using (bucket)""")
def ageing_buckets(spark, sf):
    return doubles(finance.ageing(fx.schedule(spark, sf), as_of()).drop("position"), "amount")


@query("E6_revenue_trend", uses=SCHEDULE, sql=f"""
select strftime(due_date, '%Y-%m') as month, cast(sum(amount) as double) as billed,
  cast(sum(case when status = 'paid' then amount else 0 end) as double) as collected
from schedule where strftime(due_date, '%Y-%m') <= strftime({DAY}, '%Y-%m') group by 1""")
def revenue_trend(spark, sf):
    return doubles(finance.revenue_trend(fx.schedule(spark, sf), as_of()), "billed", "collected")


ov.VIEWS["rollup"] = """select customer_id, customer_name, count(*) as engagements,
  count(*) filter (where status = 'ACTIVE') as active_engagements,
  cast(coalesce(sum(fleet_size) filter (where status = 'ACTIVE'), 0) as bigint) as fleet_size,
  coalesce(sum(monthly_recurring) filter (where status = 'ACTIVE'), 0) as monthly_recurring,
  sum(collected_amount) as collected_amount, sum(outstanding_amount) as outstanding_amount,
  sum(overdue_amount) as overdue_amount, cast(sum(overdue_count) as bigint) as overdue_count
  from portfolio group by all"""
MONEYS = ["monthly_recurring", "collected_amount", "outstanding_amount", "overdue_amount"]
SQL_ROLLUP = ("customer_id, customer_name, engagements, active_engagements, fleet_size, "
              "overdue_count, " + ", ".join(d(m) for m in MONEYS))


def ratio_sql(part: str, whole: str, places: int) -> str:
    """part / whole rounded half up on whole cents."""
    p = f"cast(round({part} * 100, 0) as hugeint)"
    w = f"cast(round({whole} * 100, 0) as hugeint)"
    scale = 10 ** places
    return (f"coalesce(cast(case when {w} <> 0 then ({p} * {2 * scale} + {w}) // (2 * {w}) end "
            f"as double) / {scale}, 0.0)")


@query("E7_customer_rollup", uses=f"{PORTFOLIO} rollup", sql=f"""
select {SQL_ROLLUP}, cast(monthly_recurring * 12 as double) as annualized,
  {ratio_sql('monthly_recurring * 100', '(select sum(monthly_recurring) from rollup)', 1)}
  as revenue_share from rollup""")
def customer_rollup(spark, sf):
    out = finance.with_share(finance.customer_rollup(fx.portfolio(spark, sf)))
    return doubles(out, *MONEYS, "annualized")


TOTALS_CTES = """with p as (select count(*) as engagements, count(*) filter (where status = 'ACTIVE') as active,
  count(*) filter (where status = 'PENDING_BILLING_AUDIT') as awaiting_audit,
  sum(monthly_recurring) filter (where status = 'ACTIVE') as mrr,
  sum(fleet_size) filter (where status = 'ACTIVE') as total_fleet,
  sum(monthly_recurring) filter (where status <> 'ACTIVE') as pipeline_value,
  sum(collected_amount) as collected_amount, sum(outstanding_amount) as outstanding_amount,
  sum(overdue_count) as missed_count, sum(overdue_amount) as missed_amount,
  count(*) filter (where overdue_count > 0) as missed_engagements,
  count(*) filter (where status = 'ACTIVE' and days_to_expiry <= 90) as expiring_90d,
  sum(monthly_recurring) filter (where status = 'ACTIVE' and days_to_expiry <= 90)
    as expiring_90d_value,
  count(*) filter (where status = 'ACTIVE' and days_to_expiry < 0) as expired from portfolio),
 c as (select count(*) as customers, count(*) filter (where active_engagements > 0)
  as active_customers from rollup),
 t as (select sum(monthly_recurring) as top5 from (select * from rollup
  order by monthly_recurring desc, customer_id limit 5))"""
SQL_TOTALS = f"""select engagements, active, awaiting_audit, engagements - active as in_pipeline, customers,
  active_customers, cast(mrr as double) as monthly_recurring, cast(mrr * 12 as double) as
  annualized, {ratio_sql('mrr', 'active', 2)} as avg_per_engagement,
  {ratio_sql('mrr', 'active_customers', 2)} as avg_per_customer,
  cast(total_fleet as bigint) as total_fleet, {ratio_sql('mrr', 'total_fleet', 2)}
  as revenue_per_vehicle, {d('pipeline_value')}, {d('collected_amount')},
  {d('outstanding_amount')}, {ratio_sql('collected_amount * 100',
  '(collected_amount + outstanding_amount)', 1)} as collection_rate,
  cast(missed_count as bigint) as missed_count, {d('missed_amount')}, missed_engagements,
  {ratio_sql('top5 * 100', 'mrr', 1)} as top5_revenue_share, expiring_90d,
  {d('expiring_90d_value')}, expired from p, c, t"""


@query("E8_portfolio_totals", uses=f"{PORTFOLIO} rollup", sql=f"{TOTALS_CTES}\n{SQL_TOTALS}")
def portfolio_totals(spark, sf):
    base = fx.portfolio(spark, sf)
    out = finance.totals(base, finance.customer_rollup(base))
    return doubles(out, "monthly_recurring", "annualized", "pipeline_value", "collected_amount",
                   "outstanding_amount", "missed_amount", "expiring_90d_value")


@query("E9_stage_funnel", uses=PORTFOLIO, sql=f"""
select b.stage, b.label, coalesce(engagements, 0) as engagements,
  cast(coalesce(value, 0) as double) as value from (values {STAGE_ROWS}) b(stage, label)
left join (select {ov.stage_case('status')} as stage, count(*) as engagements,
  sum(monthly_recurring) as value from portfolio group by 1) s using (stage)""")
def stage_funnel(spark, sf):
    return doubles(finance.stage_funnel(fx.portfolio(spark, sf)).drop("position"), "value")


@query("E10_expiry_buckets", uses=PORTFOLIO, sql=f"""
select b.bucket, b.label, coalesce(engagements, 0) as engagements,
  cast(coalesce(monthly_recurring, 0) as double) as monthly_recurring
from (values {EXPIRY_ROWS}) b(bucket, label) left join (
  select {bucket_sql('days_to_expiry', fv.EXPIRY_BUCKETS)} as bucket, count(*) as engagements,
  sum(monthly_recurring) as monthly_recurring from portfolio where status = 'ACTIVE'
  group by 1) s using (bucket)""")
def expiry_buckets(spark, sf):
    return doubles(finance.expiry_buckets(fx.portfolio(spark, sf)).drop("position"),
                   "monthly_recurring")


@query("E11_stage_board", uses="engagements", sql=f"""
select b.stage, b.label, coalesce(engagements, 0) as engagements
from (values {STAGE_ROWS}) b(stage, label) left join (select {ov.stage_case('status')} as stage,
  count(*) as engagements from engagements group by 1) s using (stage)""")
def stage_board(spark, sf):
    base = views.engagements(spark, sf).withColumn(
        "monthly_recurring", F.lit(0).cast("decimal(18,2)"))
    return finance.stage_funnel(base).drop("position", "value")


@query("E14_customer_list", uses=PORTFOLIO, sql=f"""
select c.customer_id, c.legal_name, count(engagement_id) as engagement_count,
  count(*) filter (where p.status = 'ACTIVE') as active_engagements,
  cast(coalesce(sum(fleet_size) filter (where p.status = 'ACTIVE'), 0) as bigint) as fleet_size,
  cast(coalesce(sum(monthly_recurring) filter (where p.status = 'ACTIVE'), 0) as double)
   as monthly_recurring,
  strftime(min(contract_end) filter (where p.status = 'ACTIVE'), '%Y-%m-%d')
   as next_contract_end
from customers c left join portfolio p on c.customer_id = p.customer_id group by 1, 2""")
def customer_list(spark, sf):
    live = F.col("status") == "ACTIVE"
    rolled = fx.portfolio(spark, sf).groupBy("customer_id").agg(
        F.count("*").alias("engagement_count"), F.count_if(live).alias("active_engagements"),
        F.sum(F.when(live, F.col("fleet_size"))).alias("fleet_size"),
        F.sum(F.when(live, F.col("monthly_recurring"))).cast("double")
        .alias("monthly_recurring"),
        F.min(F.when(live, F.col("contract_end"))).cast("string").alias("next_contract_end"))
    return (views.customers(spark, sf).select("customer_id", "legal_name")
            .join(rolled, "customer_id", "left")
            .na.fill(0, ["engagement_count", "active_engagements", "fleet_size",
                         "monthly_recurring"]))


@query("E26_billing_drift", uses=f"{DUES} banded", sql="""
with traced as (select engagement_id as eid, count(*) filter (where l_partkey % 13 <> 0) as cited,
  count(*) as charges from pricing_terms where not superseded group by all)
select d.engagement_id, coalesce(cited, 0) as cited, coalesce(charges, 0) as charges,
  cast(stored as double) as stored, cast(monthly_recurring as double) as recomputed,
  stored is not null and abs(stored - monthly_recurring) >= 0.01 as drifted
from (select *, case when engagement_id % 10 = 0 then cast(monthly_recurring + 5 as
  decimal(18,2)) when engagement_id % 10 = 1 then null else monthly_recurring end as stored
  from dues) d left join traced on eid = d.engagement_id""")
def billing_drift(spark, sf):
    live = views.pricing_terms(spark, sf).filter("not superseded")
    traced = live.groupBy("engagement_id").agg(
        F.count_if(F.col("l_partkey") % 13 != 0).alias("cited"),
        F.count("*").alias("charges"))
    stored = (F.when(F.col("engagement_id") % 10 == 0, F.col("monthly_recurring") + 5)
              .when(F.col("engagement_id") % 10 != 1, F.col("monthly_recurring")))
    moved = F.abs(F.col("stored") - F.col("monthly_recurring")) >= 0.01
    return (fx.dues(spark, sf).withColumn("stored", stored)
            .join(traced, "engagement_id", "left")
            .select("engagement_id", F.coalesce("cited", F.lit(0)).alias("cited"),
                    F.coalesce("charges", F.lit(0)).alias("charges"),
                    F.col("stored").cast("double").alias("stored"),
                    F.col("monthly_recurring").cast("double").alias("recomputed"),
                    F.coalesce(moved, F.lit(False)).alias("drifted")))


@query("E31_dues_fallback", uses=DUES, sql="""
select e.engagement_id, cast(case when e.engagement_id % 3 <> 0 then monthly_recurring
  when status = 'ACTIVE' then monthly_recurring end as double) as monthly_recurring
from engagements e join dues d on e.engagement_id = d.engagement_id""")
def dues_fallback(spark, sf):
    stored = F.when(F.col("engagement_id") % 3 != 0, F.col("monthly_recurring"))
    healed = F.coalesce(stored, F.when(F.col("status") == "ACTIVE", F.col("monthly_recurring")))
    return (views.engagements(spark, sf).join(fx.dues(spark, sf), "engagement_id")
            .select("engagement_id", healed.cast("double").alias("monthly_recurring")))


# --- schedule windows ------------------------------------------------------------------------
@query("F4_schedule_status", uses=SCHEDULE, sql=f"""
select engagement_id, seq, status, {d('amount')} from schedule""")
def schedule_status(spark, sf):
    return fx.schedule(spark, sf).select("engagement_id", "seq", "status",
                                         F.col("amount").cast("double"))


@query("F5_pay_early", uses=SCHEDULE, sql="""
select engagement_id, seq, status = 'upcoming' and seq = next_early as pay_early,
  status in ('due', 'overdue') or (status = 'upcoming' and seq = next_early) as payable
from schedule""")
def pay_early(spark, sf):
    return fx.schedule(spark, sf).select("engagement_id", "seq", "pay_early", "payable")


@query("I1_generate_schedule", uses="engagements", sql="""
select engagement_id, cast(i as int) as seq, case when i = 0 then 'initial' else 'recurring' end
  as kind, case when i = 0 then 'Initial payment' when billing_frequency = 'quarterly' then
  concat('Q', quarter(due), ' ', year(due)) when billing_frequency = 'annual' then
  cast(year(due) as varchar) else strftime(due, '%B %Y') end as label,
  strftime(due, '%Y-%m-%d') as due_date from (select *, cast(billing_start + to_months(cast(
   i * m as int)) as date) as due from engagements, lateral (select case billing_frequency
   when 'monthly' then 1 when 'quarterly' then 3 else 12 end as m, case billing_frequency
   when 'monthly' then 12 when 'quarterly' then 4 else 3 end as cnt) c,
   lateral (select unnest(range(cnt)) as i) r)""")
def generate_schedule(spark, sf):
    return billing.generate_schedule(views.engagements(spark, sf)).select(
        "engagement_id", "seq", "kind", "label", F.col("due_date").cast("string"))


# --- rankings --------------------------------------------------------------------------------
@query("G1_top_customers", uses=f"{PORTFOLIO} rollup", sql="""
select 'mrr' as ranking, customer_id as id, cast(monthly_recurring as double) as value from (
 select * from rollup order by monthly_recurring desc, customer_id limit 10)
union all select 'collected', customer_id, cast(collected_amount as double) from (
 select * from rollup order by collected_amount desc, customer_id limit 10)
union all select 'at_risk', customer_id, cast(overdue_amount as double) from (
 select * from rollup where overdue_amount > 0 order by overdue_amount desc, customer_id limit 10)
union all select 'engagement_mrr', engagement_id, cast(monthly_recurring as double) from (
 select * from portfolio where status = 'ACTIVE'
 order by monthly_recurring desc, engagement_id limit 10)
union all select 'recent', engagement_id, null from (
 select * from portfolio order by created_at desc, engagement_id limit 10)
union all select 'expiring', engagement_id, cast(days_to_expiry as double) from (
 select * from portfolio where status = 'ACTIVE' order by days_to_expiry, engagement_id
 limit 10)""")
def top_customers(spark, sf):
    base = fx.portfolio(spark, sf)
    rollup = finance.customer_rollup(base)
    live = base.filter("status = 'ACTIVE'")

    def ranked(df, name, key, value):
        return df.select(F.lit(name).alias("ranking"), F.col(key).alias("id"),
                         value.cast("double").alias("value"))

    parts = [
        ranked(finance.top(rollup, "monthly_recurring", "customer_id", 10), "mrr",
               "customer_id", F.col("monthly_recurring")),
        ranked(finance.top(rollup, "collected_amount", "customer_id", 10), "collected",
               "customer_id", F.col("collected_amount")),
        ranked(finance.top(rollup.filter("overdue_amount > 0"), "overdue_amount",
                           "customer_id", 10), "at_risk", "customer_id",
               F.col("overdue_amount")),
        ranked(finance.top(live, "monthly_recurring", "engagement_id", 10), "engagement_mrr",
               "engagement_id", F.col("monthly_recurring")),
        ranked(finance.top(base, "created_at", "engagement_id", 10), "recent",
               "engagement_id", F.lit(None)),
        ranked(live.orderBy("days_to_expiry", "engagement_id").limit(10), "expiring",
               "engagement_id", F.col("days_to_expiry")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("G2_engagement_order", uses=PORTFOLIO, sql=f"""
select engagement_id, status, {d('overdue_amount')}, {d('monthly_recurring')} from portfolio
order by portfolio.overdue_amount desc, status <> 'ACTIVE', portfolio.monthly_recurring desc,
 engagement_id""")
def engagement_order(spark, sf):
    rows = fx.portfolio(spark, sf).orderBy(*finance.engagement_order())
    return doubles(rows.select("engagement_id", "status", "overdue_amount",
                               "monthly_recurring"), "overdue_amount", "monthly_recurring")


@query("C6_expirable", uses=PORTFOLIO, sql="""
select engagement_id, days_to_expiry, days_to_expiry <= 90 as at_renewal from portfolio
where status = 'ACTIVE' and contract_end is not null""")
def expirable(spark, sf):
    return (fx.portfolio(spark, sf).filter("status = 'ACTIVE' and contract_end is not null")
            .select("engagement_id", "days_to_expiry",
                    (F.col("days_to_expiry") <= fv.RENEWAL_DAYS).alias("at_renewal")))


# --- jobs ------------------------------------------------------------------------------------
SQL_LINES = f"""select *, cast(coalesce(case when l_suppkey % 6 = 0 then cast(amount + 1 as
  decimal(18,2)) end, case when l_partkey % 10 <> 0 then amount end) as decimal(18,2)) as billed
  from priced_terms where not superseded"""


def terms_to_bill(spark, sf):
    """Pricing terms as stored: every sixth supplier's amount is corrected, every tenth part has none."""
    return (views.pricing_terms(spark, sf)
            .withColumn("override_amount", F.when(
                F.col("l_suppkey") % 6 == 0, (F.col("amount") + 1).cast("decimal(18,2)")))
            .withColumn("amount", F.when(F.col("l_partkey") % 10 != 0, F.col("amount")))
            .withColumn("rate_pct", F.lit(None).cast("decimal(18,2)"))
            .withColumn("override_class", F.lit(None).cast("string"))
            .withColumn("tier_bands", F.lit(None).cast(TIERS)))


def billed(spark, sf):
    return billing.billed_lines(terms_to_bill(spark, sf))


@query("E22_service_lines", uses="pricing_terms priced_terms", sql=f"""
select engagement_id, program, count(billed) as fee_items, cast(sum(billed) as double) as amount,
  bool_and(approved) as approved from ({SQL_LINES}) group by all""")
def service_lines(spark, sf):
    return doubles(billing.service_lines(billed(spark, sf)), "amount")


@query("H4_excluded_programs", uses="programs engagements pricing_terms priced_terms", sql=f"""
select e.engagement_id, coalesce(n, 0) as covered, (select count(*) from programs)
  - coalesce(n, 0) as excluded from engagements e left join (select engagement_id as eid,
  count(distinct program) as n from ({SQL_LINES}) group by all) on eid = e.engagement_id""")
def excluded_programs(spark, sf):
    programs = views.programs(spark, sf).select(
        F.concat("name", F.lit(" Program")).alias("program"))
    return billing.excluded_programs(views.engagements(spark, sf), programs, billed(spark, sf))


@query("J10_payment_schedule", uses=SCHEDULE, sql=f"""
with had as (select distinct engagement_id as eid from engagements where engagement_id % 2 = 0)
select s.engagement_id, seq, strftime(due_date, '%Y-%m-%d') as due_date, eid is null as is_new,
  case when eid is null then case when {DAY} < due_date then 'upcoming'
   when {DAY} < coalesce(lead(due_date) over (partition by s.engagement_id order by seq),
    cast(due_date + to_months(cast(months as int)) as date)) then 'due' else 'overdue' end
   else status end as status,
  cast(case when eid is null then period_amount else amount end as double) as amount
from schedule s left join had on eid = s.engagement_id""")
def payment_schedule(spark, sf):
    """Half of the engagements have a schedule already; the others get one."""
    have = fx.payments(spark, sf).filter("engagement_id % 2 = 0").withColumn(
        "is_new", F.lit(False))
    priced = views.engagements(spark, sf).join(fx.dues(spark, sf), "engagement_id")
    new = (billing.new_schedules(priced, have).withColumn("paid", F.lit(False))
           .withColumn("amount_paid", F.lit(None).cast("decimal(18,2)"))
           .withColumn("is_new", F.lit(True)))
    out = billing.with_status(have.unionByName(new), as_of())
    return out.select("engagement_id", "seq", F.col("due_date").cast("string"), "is_new",
                      "status", F.col("amount").cast("double"))


def ranked_sql(section: str, table: str, order: str, key: str, n: str, value: str, other: str) -> str:
    """The first ten rows of a table in an order, numbered."""
    return f"""select '{section}', cast({key} as varchar), row_number() over (order by {order}, {key}),
  cast({n} as bigint), cast({value} as double), cast({other} as double) from {table} t
  qualify row_number() over (order by {order}, {key}) <= 10"""


SQL_LIVE = "(select * from portfolio where status = 'ACTIVE')"
DASHBOARD_SQL = " union all ".join([
    """select 'totals' as section, key, cast(null as bigint) as place, cast(null as bigint) as n, value,
  cast(null as double) as other from (unpivot (select cast(columns(*) as double) from totals)
  on columns(*) into name key value value)""",
    f"""select 'funnel', b.stage, null, coalesce(n, 0), cast(coalesce(v, 0) as double), null
  from (values {STAGE_ROWS}) b(stage, label) left join (
  select {ov.stage_case('status')} as stage, count(*) as n, sum(monthly_recurring) as v
  from portfolio group by 1) s using (stage)""",
    f"""select 'aging', b.bucket, null, coalesce(n, 0), cast(coalesce(v, 0) as double), null
  from (values {BUCKET_ROWS}) b(bucket, label) left join (
  select case when status in ('due', 'overdue') then {SQL_AGE} else 'current' end as bucket,
  count(*) as n, sum(amount) as v from schedule group by 1) s using (bucket)""",
    f"""select 'expiry_buckets', b.bucket, null, coalesce(n, 0), cast(coalesce(v, 0) as double), null
  from (values {EXPIRY_ROWS}) b(bucket, label) left join (
  select {bucket_sql('days_to_expiry', fv.EXPIRY_BUCKETS)} as bucket, count(*) as n,
  sum(monthly_recurring) as v from portfolio where status = 'ACTIVE' group by 1) s using (bucket)""",
    f"""select 'revenue_trend', strftime(due_date, '%Y-%m'), null, null, cast(sum(amount) as double),
  cast(coalesce(sum(amount) filter (where status = 'paid'), 0) as double) from schedule
  where strftime(due_date, '%Y-%m') <= strftime({DAY}, '%Y-%m') group by 2""",
    """select 'customers', cast(customer_id as varchar), null, engagements,
  cast(monthly_recurring as double), revenue_share from shares""",
    """select 'engagements', cast(engagement_id as varchar), null, days_to_expiry,
  cast(monthly_recurring as double), cast(overdue_amount as double) from portfolio""",
    ranked_sql("top_customers", "shares", "monthly_recurring desc", "customer_id",
               "active_engagements", "monthly_recurring", "revenue_share"),
    ranked_sql("top_collected", "shares", "collected_amount desc", "customer_id",
               "engagements", "collected_amount", "outstanding_amount"),
    ranked_sql("at_risk_customers", "(select * from shares where overdue_amount > 0)",
               "overdue_amount desc", "customer_id", "overdue_count", "overdue_amount",
               "monthly_recurring"),
    ranked_sql("top_engagements", SQL_LIVE, "monthly_recurring desc", "engagement_id",
               "fleet_size", "monthly_recurring", "overdue_amount"),
    ranked_sql("recent_engagements", "portfolio", "created_at desc", "engagement_id",
               "fleet_size", "monthly_recurring", "overdue_amount"),
    ranked_sql("expiring_contracts", f"(select * from {SQL_LIVE} where days_to_expiry is not null)",
               "days_to_expiry", "engagement_id", "days_to_expiry", "monthly_recurring",
               "overdue_amount"),
])


@query("J15_finance_dashboard", uses=f"{PORTFOLIO} rollup", sql=f"""{TOTALS_CTES},
 totals as ({SQL_TOTALS}),
 shares as (select *, {ratio_sql('monthly_recurring * 100',
                                 '(select sum(monthly_recurring) from rollup)', 1)}
  as revenue_share from rollup)
{DASHBOARD_SQL}""")
def finance_dashboard(spark, sf):
    """All thirteen reports as rows: the place in a ranking, a count, the figure and a second figure."""
    # Only what the reports read is sorted and written: a schedule has up to twelve rows an engagement.
    schedule = cut_lineage(fx.schedule(spark, sf).select("engagement_id", "due_date", "status", "amount"),
                           "schedule")
    base = cut_lineage(finance.portfolio(
        views.engagements(spark, sf), fx.dues(spark, sf),
        lifecycle.cycle_in_force(views.review_cycles(spark, sf)), views.customers(spark, sf),
        schedule, as_of()), "portfolio")
    rollup = cut_lineage(finance.customer_rollup(base), "rollup")
    out = finance.dashboard(base, rollup, schedule, as_of())

    def section(name, key, n, value, other, order=None):
        def as_type(column, kind):
            return (F.lit(None) if column is None else F.col(column)).cast(kind)

        place = F.lit(None) if order is None else F.row_number().over(Window.orderBy(*order, key))
        return out[name].select(
            F.lit(name).alias("section"), F.col(key).cast("string").alias("key"),
            place.cast("bigint").alias("place"), as_type(n, "bigint").alias("n"),
            as_type(value, "double").alias("value"), as_type(other, "double").alias("other"))

    mrr = "monthly_recurring"
    figures = out["totals"].select(*[F.col(c).cast("double").alias(c) for c in out["totals"].columns])
    out["totals"] = figures.unpivot([], figures.columns, "key", "value")
    parts = [
        section("totals", "key", None, "value", None),
        section("funnel", "stage", "engagements", "value", None),
        section("aging", "bucket", "payments", "amount", None),
        section("expiry_buckets", "bucket", "engagements", mrr, None),
        section("revenue_trend", "month", None, "billed", "collected"),
        section("customers", "customer_id", "engagements", mrr, "revenue_share"),
        section("engagements", "engagement_id", "days_to_expiry", mrr, "overdue_amount"),
        section("top_customers", "customer_id", "active_engagements", mrr, "revenue_share",
                [F.desc(mrr)]),
        section("top_collected", "customer_id", "engagements", "collected_amount",
                "outstanding_amount", [F.desc("collected_amount")]),
        section("at_risk_customers", "customer_id", "overdue_count", "overdue_amount", mrr,
                [F.desc("overdue_amount")]),
        section("top_engagements", "engagement_id", "fleet_size", mrr, "overdue_amount", [F.desc(mrr)]),
        section("recent_engagements", "engagement_id", "fleet_size", mrr, "overdue_amount",
                [F.desc("created_at")]),
        section("expiring_contracts", "engagement_id", "days_to_expiry", mrr, "overdue_amount",
                [F.col("days_to_expiry")]),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


@query("J23_fleet_resync", uses=DUES, sql="""
select e.engagement_id, status = 'ACTIVE' as locked,
  case when status = 'ACTIVE' then coalesce(fleet_size_override, 1) else fleet_size end
   as fleet_size,
  case when status = 'ACTIVE' then null else cast(monthly_recurring as double) end
   as monthly_recurring
from engagements e join dues d on e.engagement_id = d.engagement_id""")
def fleet_resync(spark, sf):
    from tallypact.plans.fleet import resync

    stored = views.engagements(spark, sf).withColumn(
        "stored_fleet", F.coalesce("fleet_size_override", F.lit(1))).withColumn(
        "stored_dues", F.lit(None).cast("decimal(18,2)"))
    out = resync(stored, views.vehicles(spark, sf), views.pricing_terms(spark, sf))
    return doubles(out.select("engagement_id", "locked", "fleet_size", "monthly_recurring"),
                   "monthly_recurring")


@query("J25_payment_posting", uses=SCHEDULE, sql="""
with r as (select *, (engagement_id + seq) % 3 = 0 as asked_pay,
  status in ('due', 'overdue') or (status = 'upcoming' and seq = next_early) as payable
  from schedule)
select engagement_id, seq, 'pay' as request, case when paid then 'this payment is already paid'
  when not payable then 'this payment is not payable yet' end as refused,
  cast(amount as double) as amount from r where asked_pay
union all select engagement_id, seq, 'remind', case when paid then 'this payment is already paid'
  when status not in ('due', 'overdue') then 'this payment is not due yet'
  when engagement_id % 4 = 0 then 'no client on this engagement to remind' end,
  cast(amount as double) from r where not asked_pay""")
def payment_posting(spark, sf):
    return doubles(asked_payments(spark, sf), "amount")


def asked_payments(spark, sf):
    rows = fx.schedule(spark, sf)
    asks = rows.select("engagement_id", "seq", F.when(
        (F.col("engagement_id") + F.col("seq")) % 3 == 0, "pay").otherwise("remind")
        .alias("request"))
    clients = (views.engagements(spark, sf).filter("engagement_id % 4 <> 0")
               .select("engagement_id"))
    return payments.decide_requests(rows, asks, clients)


@query("J25_posted_payments", uses=SCHEDULE, sql="""
select engagement_id, seq, paid or (asked and payable) as paid,
  cast(case when paid or (asked and payable) then amount end as double) as amount_paid
from (select *, (engagement_id + seq) % 3 = 0 as asked, status in ('due', 'overdue')
   or (status = 'upcoming' and seq = next_early) as payable from schedule)""")
def posted_payments(spark, sf):
    """The schedule's payments after the batch: accepted ones are paid at the amount asked."""
    posted = payments.post_payments(fx.schedule(spark, sf), asked_payments(spark, sf))
    return doubles(posted.select("engagement_id", "seq", "paid", "amount_paid"), "amount_paid")
