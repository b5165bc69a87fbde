"""Column-level operators over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact import views
from tallypact.functions import billing, calls, documents, fleet, lifecycle, people, terms, text
from tallypact.operators import records as rec
from tallypact.views import AS_OF, as_of
from tallypact.workload import oracle_views as ov
from tallypact.workload.registry import query

DAY = f"DATE '{AS_OF}'"


# --- billing wordings ------------------------------------------------------------------------
@query("B1_frequency_class", uses="pricing_terms priced_terms", sql="""
select frequency, unit_basis, billing_class, count(*) as terms from priced_terms
group by all""")
def frequency_class(spark, d):
    reading = billing.frequency_class(F.col("frequency"), F.lit(""))
    return (views.pricing_terms(spark, d).select("frequency", reading.alias("r"))
            .groupBy("frequency", F.col("r.unit_basis"), F.col("r.billing_class"))
            .agg(F.count("*").alias("terms")))


OVERRIDES = """case when l_suppkey % 6 = 0 then cast(amount + 1 as decimal(18,2)) end"""
OVERRIDE_CLASS = """case l_suppkey % 9 when 0 then 'usage' when 1 then 'recurring' end"""


@query("B2_fee_item", uses="pricing_terms priced_terms", sql=f"""
with o as (select *, {OVERRIDES} as oa, {OVERRIDE_CLASS} as oc,
  case when l_partkey % 10 = 0 then null else amount end as read_amount,
  case when l_partkey % 20 = 0 then null else rate_pct end as read_rate from priced_terms)
select term_key, cast(coalesce(oa, read_amount) as double) as amount,
  case oc when 'usage' then 'per_transaction' when 'recurring' then 'per_vehicle_per_month'
    else unit_basis end as unit_basis,
  coalesce(oc, billing_class) as billing_class,
  concat_ws(',', case when oa is not null and oa is distinct from read_amount then 'amount' end,
    case when oc <> billing_class then 'billing_class' end) as corrected,
  cast(read_amount as double) as read_amount, billing_class as read_class
from o where coalesce(oa, read_amount) is not null or read_rate is not null""")
def fee_item(spark, d):
    terms_ = views.pricing_terms(spark, d)
    amount = F.when(F.col("l_partkey") % 10 != 0, F.col("amount"))
    rate = F.when(F.col("l_partkey") % 20 != 0, F.col("rate_pct"))
    override = F.when(F.col("l_suppkey") % 6 == 0,
                      (F.col("amount") + 1).cast("decimal(18,2)"))
    kind = (F.when(F.col("l_suppkey") % 9 == 0, "usage")
            .when(F.col("l_suppkey") % 9 == 1, "recurring"))
    fee = billing.fee_item(amount, F.lit(None).cast(rec.TIERS), rate,
                           billing.frequency_class(F.col("frequency")), override, kind)
    return (terms_.select("term_key", fee.alias("fee")).filter("fee is not null")
            .select("term_key", F.col("fee.amount").cast("double").alias("amount"),
                    "fee.unit_basis", "fee.billing_class",
                    F.array_join("fee.corrected", ",").alias("corrected"),
                    F.col("fee.as_read.amount").cast("double").alias("read_amount"),
                    F.col("fee.as_read.billing_class").alias("read_class")))


SQL_NORM = """array_to_string(list_transform(list_filter(
  regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({x}), '\\([^)]*\\)', ' ', 'g'),
    '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda w: w <> '' and w not in ({stop})),
  lambda w: case when length(w) > 4 and w like '%s' and w not like '%ss'
    then left(w, length(w) - 1) else w end), ' ')"""
SQL_SLUG = """coalesce(nullif(array_to_string(list_filter(
  regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({x}), '\\([^)]*\\)', ' ', 'g'),
    '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda w: w <> '' and w not in ({stop})), '-'), ''),
  'unnamed')"""


def sql_norm(column: str) -> str:
    return SQL_NORM.format(x=column, stop=ov.quoted(fv.NAME_STOPWORDS))


def sql_slug(column: str) -> str:
    return SQL_SLUG.format(x=column, stop=ov.quoted(fv.NAME_STOPWORDS))


@query("B3_normalise_name", uses="raw_names", sql=f"""
select raw, {sql_norm('raw')} as name_key, count(*) as uses from raw_names group by all""")
def normalise_name(spark, d):
    return (views.raw_names(spark, d).groupBy("raw").agg(F.count("*").alias("uses"))
            .withColumn("name_key", text.normalise_name(F.col("raw"))))


@query("B4_slugify", uses="raw_names", sql=f"""
select distinct raw, {sql_slug('raw')} as slug from raw_names""")
def slugify(spark, d):
    return (views.raw_names(spark, d).select("raw").distinct()
            .withColumn("slug", text.slugify(F.col("raw"))))


@query("B5_norm_text", uses="", sql="""
select item_id as quote_id, regexp_replace(lower(text), '[^a-z0-9$%/-]', '', 'g') as stream
from benchmark""")
def norm_text(spark, d):
    return views.quotes(spark, d).select("quote_id", text.norm_text(F.col("quote")).alias("stream"))


def sql_money(x: str) -> str:
    return f"regexp_replace(cast(cast({x} as decimal(18,2)) as varchar), '\\.?0+$', '')"


@query("B6_fee_line", uses="pricing_terms priced_terms", sql=f"""
select term_key, concat_ws(' · ', '$' || {sql_money('amount')},
  case when l_suppkey % 3 = 0 then 'cost + ' else '' end || {sql_money('rate_pct')} || '%',
  replace(unit_basis, '_', ' '),
  case when l_suppkey % 4 = 0 then 'min $' || {sql_money('rate_pct')} end,
  case when l_suppkey % 5 = 0 then 'units 1-' || l_suppkey || ': $' || {sql_money('amount')} end,
  case when l_suppkey % 5 = 0 then 'units ' || (l_suppkey + 1) || '-∞: $'
    || {sql_money('rate_pct')} end) as fee
from priced_terms""")
def fee_line(spark, d):
    df = views.pricing_terms(spark, d)
    none = F.lit(None).cast("decimal(18,2)")
    band = F.array(rec.band(F.lit(1), F.col("l_suppkey"), F.col("amount")),
                   rec.band(F.col("l_suppkey") + 1, F.lit(None), F.col("rate_pct")))
    return df.select("term_key", billing.fee_line(
        F.col("amount"), F.col("rate_pct"),
        F.when(F.col("l_suppkey") % 3 == 0, "cost_plus"),
        billing.frequency_class(F.col("frequency")).unit_basis,
        F.when(F.col("l_suppkey") % 4 == 0, F.col("rate_pct")).otherwise(none),
        F.when(F.col("l_suppkey") % 5 == 0, band)).alias("fee"))


# --- extracted records -----------------------------------------------------------------------
@query("B7_record_id", uses="records", sql=f"""
select ordinal, {ov.SQL_RECORD_ID} as record_id from records""")
def record_id(spark, d):
    return views.records(spark, d).select("ordinal", terms.record_id().alias("record_id"))


BODY = ["program", "item", "frequency", "amount", "calculation", "notes"]


@query("B8_body_hash", uses="records", sql="""
select ordinal, sha1(concat_ws(chr(31), 'amount=' || coalesce(cast(amount as varchar), ''),
  'calculation=' || coalesce(calculation, ''), 'frequency=' || coalesce(frequency, ''),
  'item=' || coalesce(item, ''), 'notes=' || coalesce(notes, ''),
  'program=' || coalesce(program, ''))) as body_hash from records""")
def body_hash(spark, d):
    return views.records(spark, d).select("ordinal", terms.body_hash(BODY).alias("body_hash"))


@query("B9_titles", uses="records", sql="""
with t as (select ordinal, coalesce(nullif(case info_type
   when 'pricing_item' then item when 'sla_item' then category
   when 'reporting_requirement' then report_name when 'definition' then term
   when 'online_tool' then tool_name when 'responsibility' then task when 'signature' then name
   when 'information_section' then topic else item end, ''),
   case when info_type = 'pricing_item' then nullif(program, '') end, info_type) as title,
  nullif(case info_type when 'pricing_item' then program
   when 'sla_item' then contract_sub_section when 'reporting_requirement' then frequency
   when 'online_tool' then platform when 'responsibility' then responsible_party
   when 'signature' then company end, '') as sub from records)
select ordinal, title, case when lower(trim(sub)) <> lower(trim(title)) then sub end as subtitle
from t""")
def titles(spark, d):
    return (views.records(spark, d).select("ordinal", terms.titles().alias("t"))
            .select("ordinal", "t.title", "t.subtitle"))


@query("B10_needs_review", uses="records", sql="""
select ordinal, (confidence <= 0.8 or quote is null or (info_type = 'pricing_item' and
  (catalog_match in ('fuzzy', 'unmatched') or (item is not null and not included and
   amount is null and calculation is null)))) as needs_review from records""")
def needs_review(spark, d):
    return views.records(spark, d).select("ordinal", terms.needs_review().alias("needs_review"))


@query("B11_review_flags", uses="records", sql="""
select label, reason, count(*) as flags from (
 select coalesce(item, program, info_type) as label, unnest(list_filter([
  case when confidence <= 0.8 then 'confidence ' || cast(confidence as varchar) end,
  case when quote is null then 'no citation' end,
  case when info_type = 'pricing_item' and item is not null and not included and amount is null
    and calculation is null then 'priced line with no price' end], lambda r: r is not null))
  as reason from records) group by all""")
def review_flags(spark, d):
    label = F.coalesce("item", "program", "info_type")
    return (views.records(spark, d)
            .select(label.alias("label"), F.explode(terms.review_flags()).alias("reason"))
            .groupBy("label", "reason").agg(F.count("*").alias("flags")))


@query("B12_category_of", uses="records", sql="""
select c.category, count(r.ordinal) as records from
 (select unnest(['pricing', 'sla', 'reporting', 'misc']) as category) c
 left join (select ordinal, case info_type when 'pricing_item' then 'pricing'
   when 'sla_item' then 'sla' when 'reporting_requirement' then 'reporting' else 'misc' end as k
   from records) r on r.k = c.category group by all""")
def category_of(spark, d):
    return rec.counts_by_category(views.records(spark, d))


@query("B13_lenient_codes", uses="", sql="""
select l_shipmode_code as code, count(*) as n, case when l_shipmode_code is null then null
  when l_shipmode_code in ('flat','per_unit','per_transaction','percentage','cost_plus',
   'tiered','minimum','conditional','other') then l_shipmode_code
  when l_shipmode_code in ('FLAT','TIERED') then lower(l_shipmode_code) else 'other' end
  as fee_type, cast(l_shipmode_code as varchar) as shown from (select case l_linenumber
   when 1 then 'flat' when 2 then 'TIERED' when 3 then 'Flat' when 4 then 'barter'
   when 5 then null else 'cost_plus' end as l_shipmode_code from lineitem) group by all""")
def lenient_codes(spark, d):
    code = views.by_value(F.col("l_linenumber"),
                          {1: "flat", 2: "TIERED", 3: "Flat", 4: "barter"}, "cost_plus")
    code = F.when(F.col("l_linenumber") != 5, code)
    return (views.table(spark, d, "lineitem").select(code.alias("code"))
            .groupBy("code").agg(F.count("*").alias("n"))
            .withColumn("fee_type", terms.lenient_code(F.col("code"), fv.FEE_TYPES, "other"))
            .withColumn("shown", F.col("code").cast("string")))


# --- documents -------------------------------------------------------------------------------
LEASE, SERVICE = fv.LEASE_PHRASES, fv.SERVICE_PHRASES
SQL_DOC_TYPE = f"""select document_id, engagement_id, created_ord, full_text,
 len(regexp_extract_all(full_text, '{LEASE}', 0, 'i')) as lease,
 len(regexp_extract_all(full_text, '{SERVICE}', 0, 'i')) as service,
 strpos(full_text, regexp_extract(full_text, '{LEASE}', 0, 'i')) as lease_at,
 strpos(full_text, regexp_extract(full_text, '{SERVICE}', 0, 'i')) as service_at
 from agreements"""
ov.VIEWS["typed"] = f"""select document_id, engagement_id, created_ord, full_text,
 case when lease = 0 and service = 0 then 'UNKNOWN'
  when lease = service then case when lease_at < service_at then 'MLA' else 'MSA' end
  when lease > service then 'MLA' else 'MSA' end as doc_type,
 case when lease = 0 and service = 0 then 0.0::double when lease = service then 0.6::double
  else round_even(least(0.99::double, 0.6::double + 0.4::double * abs(lease - service)
    / greatest(lease, service)), 2) end as confidence from ({SQL_DOC_TYPE})"""

LEAD = fv.EFFECTIVE_LEAD.replace("\\-", "-")
M = "|".join(fv.MONTHS)


def _sql_date(pattern, y, m, dd, named=True):
    def x(group):
        return f"regexp_extract(full_text, '{pattern}', {group}, 'i')"

    month = (f"cast(list_position([{ov.quoted(fv.MONTHS)}], lower({x(m)})) as varchar)"
             if named else x(m))
    made = (f"try_cast(concat({x(y)}, '-', lpad({month}, 2, '0'), '-', "
            f"lpad({x(dd)}, 2, '0')) as date)")
    return f"case when year({made}) > 1900 and year({made}) < 2200 then {made} end"


_D = r"(\d{1,2})(?:st|nd|rd|th)?"
ov.VIEWS["dated"] = f"""select *, coalesce(
 {_sql_date(LEAD + f'({M})' + r'\s+' + _D + r',?\s+(\d{4})', 3, 1, 2)},
 {_sql_date(LEAD + _D + r'\s+' + f'({M})' + r',?\s+(\d{4})', 3, 2, 1)},
 {_sql_date(LEAD + r'(\d{4})-(\d{2})-(\d{2})', 1, 2, 3, False)}) as effective_date from typed"""


@query("B14_document_type", uses="agreements typed", sql="""
select document_id, doc_type, confidence from typed""")
def document_type(spark, d):
    return (views.agreements(spark, d)
            .select("document_id", documents.classify_doc_type(F.col("full_text")).alias("t"))
            .select("document_id", "t.doc_type", "t.confidence"))


@query("B15_effective_date", uses="agreements typed dated", sql="""
select document_id, strftime(effective_date, '%Y-%m-%d') as effective_date from dated""")
def effective_date(spark, d):
    return views.agreements(spark, d).select(
        "document_id", documents.effective_date(F.col("full_text")).cast("string")
        .alias("effective_date"))


SQL_SANITY = f"""list_filter([
  case when len(tokens) > 0 and len(list_filter(tokens, lambda t: contains(low, t))) = 0
   then 'document does not mention the client ''' || client || '''' end,
  case when expected = 'MSA' and contains(low, 'master lease agreement')
   and not contains(low, 'master service agreement')
   then 'expected an MSA but the document reads as a Master Lease Agreement' end,
  case when expected = 'MLA' and contains(low, 'master service agreement')
   and not contains(low, 'master lease agreement')
   then 'expected an MLA but the document reads as a Master Service Agreement' end],
  lambda r: r is not null)"""
ov.VIEWS["sanity"] = f"""select document_id, array_to_string({SQL_SANITY}, '; ') as reasons from (
  select *, lower(full_text) as low, list_filter(regexp_split_to_array(lower(client), '\\W+'),
   lambda t: length(t) > 3 and t not in ({ov.quoted(fv.ENTITY_STOPWORDS)})) as tokens from (
   select document_id, full_text, source || ' Corp' as client,
    case when document_id % 2 = 0 then 'MSA' else 'MLA' end as expected
    from agreements join documents on document_id = doc_id))"""


def reuploads(spark, d):
    """Agreements with the client they should name and the slot they were put in."""
    source = views.table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat("source", F.lit(" Corp")).alias("client"))
    return views.agreements(spark, d).join(source, "document_id").withColumn(
        "expected", F.when(F.col("document_id") % 2 == 0, "MSA").otherwise("MLA"))


@query("B16_sanity_check", uses="agreements sanity", sql="""
select document_id, reasons = '' as passed, reasons from sanity""")
def sanity_check(spark, d):
    reasons = documents.sanity_reasons(F.col("full_text"), F.col("client"), F.col("expected"))
    return (reuploads(spark, d).select("document_id", reasons.alias("r"))
            .select("document_id", (F.size("r") == 0).alias("passed"),
                    F.array_join("r", "; ").alias("reasons")))


# --- fleet and lifecycle codes ---------------------------------------------------------------
SQL_DUTY = "case " + " ".join(
    f"when body_class in ({ov.quoted(b)}) then '{band}'" for band, b in fv.DUTY_BANDS.items()
) + " end"


@query("B17_vehicle_invariants", uses="vehicles", sql=f"""
select {SQL_DUTY} as duty_band, case when ownership = 'CUSTOMER_OWNED' and status = 'IN_STOCK'
  then 'a customer-owned vehicle cannot be IN_STOCK'
  when ownership = 'CUSTOMER_OWNED' and owner_customer_id is null
  then 'a customer-owned vehicle requires a customer_id' end as problem,
  ownership = 'PROVIDER_OWNED' and status = 'IN_STOCK' as available, count(*) as vehicles
from vehicles group by all""")
def vehicle_invariants(spark, d):
    own, status = F.col("ownership"), F.col("status")
    return (views.vehicles(spark, d)
            .groupBy(fleet.duty_band(F.col("body_class")).alias("duty_band"),
                     fleet.vehicle_problem(own, status, F.col("owner_customer_id"))
                     .alias("problem"),
                     fleet.is_available(own, status).alias("available"))
            .agg(F.count("*").alias("vehicles")))


@query("B18_stage_of", uses="engagements", sql=f"""
select status, {ov.stage_case('status')} as stage, count(*) as engagements from engagements
group by all""")
def stage_of(spark, d):
    return (views.engagements(spark, d).groupBy("status")
            .agg(F.count("*").alias("engagements"))
            .withColumn("stage", lifecycle.stage_of(F.col("status"))))


@query("B19_cycle_labels", uses="submissions", sql="""
select submission_id, case when cycle <= 1 then 'Original agreement'
  else 'Amendment ' || (cycle - 1) end as label, status = 'ACTIVE' as can_amend
from submissions""")
def cycle_labels(spark, d):
    return views.submissions(spark, d).select(
        "submission_id", lifecycle.cycle_label(F.col("cycle")).alias("label"),
        lifecycle.can_amend(F.col("status")).alias("can_amend"))


@query("B20_effective_fleet", uses="engagements vehicles fleet_sizes", sql="""
select f.engagement_id, f.fleet_size, case when fleet_size_override is not null then 'override'
  else 'derived' end as fleet_source, status = 'ACTIVE' as locked
from fleet_sizes f join engagements e on e.engagement_id = f.engagement_id""")
def effective_fleet(spark, d):
    from tallypact.plans.billing import fleet_sizes

    return fleet_sizes(views.engagements(spark, d), views.vehicles(spark, d)).select(
        "engagement_id", "fleet_size",
        billing.fleet_source(F.col("fleet_size_override")).alias("fleet_source"),
        billing.fleet_locked(F.col("status")).alias("locked"))


@query("B21_billing_cadence", uses="engagements", sql="""
select engagement_id, cadence, case cadence when 'quarterly' then 3 when 'annual' then 12
  else 1 end as months from (select engagement_id, case
   when lower(wording) like '%quarter%' then 'quarterly'
   when lower(wording) like '%year%' or lower(wording) like '%annual%' then 'annual'
   else 'monthly' end as cadence from (select engagement_id, case engagement_id % 5
    when 0 then 'Each Quarter' when 1 then 'once a YEAR' when 2 then null
    else billing_frequency end as wording from engagements))""")
def billing_cadence(spark, d):
    wording = (F.when(F.col("engagement_id") % 5 == 0, "Each Quarter")
               .when(F.col("engagement_id") % 5 == 1, "once a YEAR")
               .when(F.col("engagement_id") % 5 == 2, None)
               .otherwise(F.col("billing_frequency")))
    cadence = billing.normalize_frequency(wording)
    return views.engagements(spark, d).select(
        "engagement_id", cadence.alias("cadence"),
        billing.period_months(cadence).alias("months"))


@query("B22_contract_end", uses="engagements", sql="""
select engagement_id, strftime(coalesce(case when engagement_id % 7 = 0 then created_at end,
  cast(created_at + to_months(contract_term_months) as date)), '%Y-%m-%d') as contract_end
from engagements""")
def contract_end(spark, d):
    stored = F.when(F.col("engagement_id") % 7 == 0, F.col("created_at"))
    return views.engagements(spark, d).select(
        "engagement_id", billing.contract_end(
            stored, F.col("created_at"), F.col("contract_term_months")).cast("string")
        .alias("contract_end"))


@query("B23_period_label", uses="engagements", sql="""
select engagement_id, case billing_frequency
  when 'quarterly' then concat('Q', quarter(billing_start), ' ', year(billing_start))
  when 'annual' then cast(year(billing_start) as varchar)
  else strftime(billing_start, '%B %Y') end as label from engagements""")
def period_label(spark, d):
    return views.engagements(spark, d).select("engagement_id", billing.period_label(
        F.col("billing_frequency"), F.col("billing_start")).alias("label"))


@query("B24_billing_start", uses="engagements", sql=f"""
select engagement_id, strftime(coalesce(try_cast(stored as date), try_cast(generated as date),
  created_at, {DAY}), '%Y-%m-%d') as billing_start from (select engagement_id, created_at,
  case when engagement_id % 3 = 0 then strftime(billing_start, '%Y-%m-%d') end as stored,
  case engagement_id % 3 when 1 then 'not a date' when 2 then
   strftime(billing_start + to_days(3), '%Y-%m-%dT10:00:00') end as generated
  from engagements)""")
def billing_start(spark, d):
    df = views.engagements(spark, d)
    stored = F.when(F.col("engagement_id") % 3 == 0, F.col("billing_start").cast("string"))
    generated = (F.when(F.col("engagement_id") % 3 == 1, "not a date")
                 .when(F.col("engagement_id") % 3 == 2, F.concat(
                     F.date_add("billing_start", 3).cast("string"), F.lit("T10:00:00"))))
    return df.select("engagement_id", billing.billing_start(
        stored, generated, F.col("created_at").cast("string"), as_of()).cast("string")
        .alias("billing_start"))


@query("B25_review_sort_key", uses="pricing_terms", sql="""
select term_key, concat('RV#', case when confidence <= 0.8 then '0' else '1' end, '#C#',
  lpad(cast(cast(confidence * 100 as int) as varchar), 3, '0')) as sort_key
from pricing_terms""")
def review_sort_key(spark, d):
    return views.pricing_terms(spark, d).select("term_key", terms.review_sort_key(
        F.col("confidence") <= 0.8, F.col("confidence")).alias("sort_key"))


ov.VIEWS["doc_lines"] = """select document_id, unnest(string_split(full_text, chr(10))) as line,
  generate_subscripts(string_split(full_text, chr(10)), 1) as line_no from agreements"""
ov.VIEWS["doc_pages"] = """select document_id, cast((line_no - 1) // 5 + 1 as int) as page_number,
  string_agg(line, chr(10) order by line_no) as page_text, max(line_no) as last_line
  from doc_lines group by all"""


def page_text(page):
    return F.array_join(page.lines, "\n")


@query("B26_page_tokens", uses="agreements doc_lines doc_pages", sql="""
select document_id, page_number, cast((length(page_text) + list_sum(list_transform(
  regexp_split_to_array(page_text, ' '), lambda c: length(c) + 3))) // 4 as int) as tokens
from doc_pages""")
def page_tokens(spark, d):
    pages = views.document_pages(spark, d).select("document_id", F.explode("pages").alias("p"))
    text_ = page_text(F.col("p"))
    cells = F.array(F.split(text_, " "))
    return pages.select("document_id", F.col("p.page_number").alias("page_number"),
                        documents.page_tokens(text_, cells).alias("tokens"))


# --- call costs ------------------------------------------------------------------------------
ov.VIEWS["prices"] = "select * from (values " + ", ".join(
    f"('{f}', {p[0]}::decimal(12,6), {p[1]}::decimal(12,6), "
    f"{(p[0] * fv.CACHE_WRITE_FACTOR if p[2] is None else p[2]):.6f}::decimal(12,6), "
    f"{(p[0] * fv.CACHE_READ_FACTOR if p[3] is None else p[3]):.6f}::decimal(12,6), {p[4]})"
    for f, p in fv.MODEL_PRICES.items()) + ") v(family, p_in, p_out, p_write, p_read, cap)"
ov.VIEWS["priced_calls"] = """select * from (select c.*, p.*, row_number() over (
   partition by run_id, call_no order by length(family) desc) as rn
   from calls c left join prices p on contains(lower(model), family)) where rn = 1"""
SQL_COST = """cast(round(cast(input_tokens * p_in + output_tokens * p_out
  + cache_read_tokens * p_read + cache_write_tokens * p_write as decimal(30,6))
  * 0.000001::decimal(7,6), 6) as double)"""
SQL_UNCACHED = """cast(round(cast((input_tokens + cache_read_tokens + cache_write_tokens) * p_in
  + output_tokens * p_out as decimal(30,6)) * 0.000001::decimal(7,6), 6) as double)"""


def call_columns():
    return [F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens",
                               "cache_write_tokens")]


@query("B27_call_cost", uses="calls prices priced_calls", sql=f"""
select run_id, call_no, {SQL_COST} as cost_usd, {SQL_UNCACHED} as uncached_cost_usd
from priced_calls""")
def call_cost(spark, d):
    price = calls.price_of(F.col("model"))
    return views.calls(spark, d).withColumn("price", price).select(
        "run_id", "call_no",
        calls.call_cost_usd(F.col("price"), *call_columns()).alias("cost_usd"),
        calls.uncached_cost_usd(F.col("price"), *call_columns()).alias("uncached_cost_usd"))


@query("B28_truncated_calls", uses="calls prices priced_calls", sql="""
select run_id, call_no, (input_tokens % 41 = 0 or input_tokens % 37 = 0 or stop_reason not in
  ('end_turn','tool_use','stop_sequence','stop','complete')
  or output_tokens >= coalesce(cap, 64000) / 100 - 32) as truncated
from priced_calls""")
def truncated_calls(spark, d):
    cap = F.coalesce(calls.price_of(F.col("model")).max_output_tokens,
                     F.lit(fv.DEFAULT_OUTPUT_CAP)) / 100
    return views.calls(spark, d).select("run_id", "call_no", calls.truncated(
        F.col("input_tokens") % 41 == 0, F.col("input_tokens") % 37 == 0,
        F.col("stop_reason"), F.col("output_tokens"), cap).alias("truncated"))


@query("B29_visible_actions", uses="audit_events", sql=f"""
select action, action in ({ov.quoted(fv.CLIENT_VISIBLE_ACTIONS)}) as client_sees,
  count(*) as events from audit_events group by all""")
def visible_actions(spark, d):
    return (views.audit_events(spark, d).groupBy("action").agg(F.count("*").alias("events"))
            .withColumn("client_sees", lifecycle.visible_to(F.col("action"), F.lit(True))))


@query("B30_page_marked_text", uses="agreements doc_lines doc_pages", sql="""
select document_id, string_agg(concat('===== PAGE ', page_number, ' =====', chr(10), page_text),
  chr(10) || chr(10) order by page_number) as marked from doc_pages group by document_id""")
def page_marked_text(spark, d):
    return views.document_pages(spark, d).select(
        "document_id", documents.page_marked_text(F.col("pages")).alias("marked"))


@query("B30_table_block", uses="agreements doc_lines doc_pages", sql="""
select document_id, page_number, concat('----- PAGE ', page_number, ' TABLE 1 (',
  len(rows_), ' rows) -----', chr(10), array_to_string(list_transform(rows_, lambda r: concat(
   '| ', array_to_string(list_transform(string_split(r, ','), lambda c: trim(c)), ' | '), ' |')),
   chr(10))) as block from (select document_id, page_number,
   list(line order by line_no) as rows_ from (select *, cast((line_no - 1) // 5 + 1 as int)
   as page_number from doc_lines) group by all)""")
def table_block(spark, d):
    pages = views.document_pages(spark, d).select("document_id", F.explode("pages").alias("p"))
    rows = F.transform(F.col("p.lines"), lambda line: F.split(line, ","))
    return pages.select("document_id", F.col("p.page_number").alias("page_number"),
                        documents.table_block(F.col("p.page_number"), F.lit(1), rows)
                        .alias("block"))


@query("B31_clean_heading", uses="", sql=r"""
with h as (select distinct concat(upper(p_name), ' MVR-POINT PROGRAM (SECTION ', p_size, ')')
  as raw from part),
 f as (select raw, regexp_replace(regexp_extract(trim(raw),
  '^([A-Z][A-Z0-9&/\-–()'' ,.]{6,80}?PROGRAM)\b', 1), '(?i)\s*\(SECTION[^)]*\)\s*$', '') as nm
  from h)
select raw, nullif(replace(replace(array_to_string(list_transform(
  regexp_extract_all(nm, '([A-Za-z]+|[^A-Za-z]+)'),
  lambda r: upper(left(r, 1)) || lower(substr(r, 2))), ''), 'Mvr', 'MVR'), 'Dot', 'DOT'), '')
  as heading from f""")
def clean_heading(spark, d):
    raw = F.concat(F.upper("p_name"), F.lit(" MVR-POINT PROGRAM (SECTION "),
                   F.col("p_size").cast("string"), F.lit(")"))
    return (views.table(spark, d, "part").select(raw.alias("raw")).distinct()
            .withColumn("heading", text.clean_heading(F.col("raw"))))


SQL_WORDS = """list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(
  regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' '),
  lambda w: w <> '' and w not in ({noise}))))"""


def sql_words(x: str) -> str:
    return SQL_WORDS.format(x=x, noise=ov.quoted(fv.SCORING_NOISE))


@query("B32_key_words", uses="quotes", sql=f"""
select quote_id, array_to_string({sql_words('quote')}, ' ') as words from quotes""")
def key_words(spark, d):
    return views.quotes(spark, d).select(
        "quote_id", F.array_join(text.key_words(F.col("quote")), " ").alias("words"))


FILLED = ["program", "item", "frequency", "amount", "calculation", "notes", "term", "topic"]


@query("B33_completeness", uses="records", sql="""
select ordinal, """ + " + ".join(
    f"(case when coalesce(cast({c} as varchar), '') <> '' then 1 else 0 end)" for c in FILLED)
    + " as filled from records")
def completeness(spark, d):
    return views.records(spark, d).select("ordinal", terms.completeness(FILLED).alias("filled"))


@query("B34_pct", uses="pricing_terms", sql="""
select program, coalesce(cast(floor((1000 * part * 2 + n) / (2 * n)) / 10 as double), 0)
  as approved_pct from (select program, count(*) filter (where approved) as part,
  count(*) filter (where not superseded) as n from pricing_terms group by program)""")
def pct(spark, d):
    return (views.pricing_terms(spark, d).groupBy("program")
            .agg(F.count_if("approved").alias("part"), F.count_if(~F.col("superseded")).alias("n"))
            .select("program", billing.pct(F.col("part"), F.col("n")).alias("approved_pct")))


@query("B35_parse_groups", uses="", sql="""
select claim, array_to_string(groups, ',') as groups, list_contains(groups, 'provider') or
  list_contains(groups, 'finance') as is_provider, case when list_contains(groups, 'provider')
  then 'provider' when list_contains(groups, 'finance') then 'finance' else 'client' end as role,
  n from (select claim, n, list_filter(list_transform(regexp_split_to_array(trim(replace(
   regexp_replace(regexp_replace(claim, '^[\\[\\]]+', ''), '[\\[\\]]+$', ''), ',', ' ')), '\\s+'),
   lambda w: trim(w, '"''')), lambda w: w <> '') as groups from (
   select case user_id % 5 when 0 then '[provider finance]' when 1 then 'client,finance'
    when 2 then '["provider"]' when 3 then '' else event_type end as claim, count(*) as n
    from events group by all))""")
def parse_groups(spark, d):
    claim = (F.when(F.col("user_id") % 5 == 0, "[provider finance]")
             .when(F.col("user_id") % 5 == 1, "client,finance")
             .when(F.col("user_id") % 5 == 2, '["provider"]')
             .when(F.col("user_id") % 5 == 3, "").otherwise(F.col("event_type")))
    groups = people.parse_groups(F.col("claim"))
    return (views.table(spark, d, "events").select(claim.alias("claim"))
            .groupBy("claim").agg(F.count("*").alias("n"))
            .select("claim", "n", F.array_join(groups, ",").alias("groups"),
                    people.is_provider(groups).alias("is_provider"),
                    people.group_role(groups).alias("role")))


@query("B36_display_formats", uses="engagements", sql="""
select o_orderkey as engagement_id, format('${:,.2f}', o_totalprice) as amount,
  strftime(cast(o_orderdate as date), '%d %b %Y') as due from orders""")
def display_formats(spark, d):
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("engagement_id"),
        text.dollars(F.col("o_totalprice")).alias("amount"),
        text.long_date(F.col("o_orderdate").cast("date")).alias("due"))


SQL_REQUIRED = """case scope when 'LEASE_ONLY' then ['MLA'] when 'SERVICE_ONLY' then ['MSA']
  else ['MLA', 'MSA'] end"""
ov.VIEWS["scoped"] = """select engagement_id, case when l and s then 'LEASE_AND_SERVICE'
  when l then 'LEASE_ONLY' when s then 'SERVICE_ONLY' end as scope, present from (
  select engagement_id, coalesce(bool_or(doc_type = 'MLA'), false) as l,
   coalesce(bool_or(doc_type = 'MSA'), false) as s,
   list(distinct doc_type) filter (where doc_type <> 'UNKNOWN') as present
  from (select * replace (case when created_ord % 3 = 0 then -engagement_id else engagement_id
   end as engagement_id) from typed) group by engagement_id)"""


def scopes(spark, d):
    """Scope and types present per engagement; a third of the agreements belongs to others."""
    kind = documents.classify_doc_type(F.col("full_text")).doc_type
    return rec.scope_by_engagement(
        views.agreements(spark, d).select(
            F.when(F.col("created_ord") % 3 == 0, -F.col("engagement_id")).otherwise(
                F.col("engagement_id")).alias("engagement_id"), kind.alias("doc_type")))


@query("B37_missing_types", uses="agreements typed scoped", sql=f"""
select engagement_id, array_to_string({SQL_REQUIRED}, ',') as required,
  array_to_string(list_filter({SQL_REQUIRED}, lambda t: not list_contains(
   coalesce(present, []), t)), ',') as missing from scoped""")
def missing_types(spark, d):
    required = documents.required_types(F.col("scope"))
    return scopes(spark, d).select(
        "engagement_id", F.array_join(required, ",").alias("required"),
        F.array_join(F.array_except(required, "present"), ",").alias("missing"))


@query("B38_derive_scope", uses="agreements typed scoped",
       sql="select engagement_id, scope from scoped")
def derive_scope(spark, d):
    return scopes(spark, d).select("engagement_id", "scope")


@query("B39_has_text_layer", uses="agreements doc_lines doc_pages", sql="""
select document_id, sum(length(trim(page_text, E' \\n'))) > 50 * count(*) as has_text from doc_pages
group by document_id""")
def has_text_layer(spark, d):
    chars = F.aggregate("pages", F.lit(0).cast("bigint"), lambda acc, p: acc + F.length(
        F.regexp_replace(page_text(p), "^[ \n]+|[ \n]+$", "")))
    return views.document_pages(spark, d).select(
        "document_id", (chars > 50 * F.greatest(F.size("pages"), F.lit(1))).alias("has_text"))


@query("B40_billing_override", uses="pricing_terms", sql=f"""
with o as (select term_key, cast(amount as decimal(18,2)) as amount, {OVERRIDES} as oa,
  {OVERRIDE_CLASS} as oc from pricing_terms)
select term_key, cast(coalesce(oa, amount) as double) as billed_amount, oc as billed_class,
  case when oa is null and oc is null then 'no change' else concat_ws(', ',
   case when oa is not null then concat('amount ', amount, ' -> ', oa) end,
   case when oc is not null then concat('billed as read -> ', oc) end) end as change from o""")
def billing_override(spark, d):
    from tallypact.plans.changes import apply_overrides

    df = views.pricing_terms(spark, d).withColumn(
        "billing_override", F.lit(None).cast(rec.OVERRIDE))
    patches = df.select(
        "term_key",
        F.when(F.col("l_suppkey") % 6 == 0, (F.col("amount") + 1).cast("decimal(18,2)"))
        .alias("patch_amount"),
        F.when(F.col("l_suppkey") % 9 == 0, "usage")
        .when(F.col("l_suppkey") % 9 == 1, "recurring").alias("patch_class"),
        F.lit("auditor").alias("patch_by"), F.lit(AS_OF).alias("patch_at"))
    return apply_overrides(df, patches, "term_key").select(
        "term_key",
        F.coalesce("billing_override.amount", "amount").cast("double").alias("billed_amount"),
        F.col("billing_override.billing_class").alias("billed_class"), "change")
