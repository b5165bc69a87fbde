"""Queries over agreements: standing, citations, page windows, change review."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact import views
from tallypact.functions import documents as doc_fn
from tallypact.functions.text import norm_text, slugify
from tallypact.operators.containment import passages_in, quote_streams
from tallypact.operators.records import TIERS
from tallypact.plans import billing, citations, corrections, documents, fleet, lifecycle, review
from tallypact.plans.terms import DOCUMENT, coverage
from tallypact.session import cut_lineage
from tallypact.workload import fixtures as fx
from tallypact.workload import oracle_views as ov
from tallypact.workload.money import SQL_LINES, billed, terms_to_bill
from tallypact.workload.name_sql import UNPLACED
from tallypact.workload.registry import query
from tallypact.workload.scalars import SQL_REQUIRED, page_text, sql_money, sql_norm, sql_slug

RANKS = ov.quoted(fv.MATCH_KINDS)


# --- standing --------------------------------------------------------------------------------
ov.VIEWS["docs"] = """select document_id, engagement_id, doc_type, effective_date, created_ord,
  cast(1 + document_id % 3 as int) as current_version,
  case when document_id % 2 = 0 then 'CURRENT' else 'SUPERSEDED' end as standing from dated"""
ov.VIEWS["ranked"] = """select *, case when doc_type = 'UNKNOWN' or row_number() over (
   partition by engagement_id, doc_type order by coalesce(strftime(effective_date, '%Y-%m-%d'),
   '') desc, created_ord desc, document_id desc) = 1 then 'CURRENT' else 'SUPERSEDED' end
   as ranked_standing from docs"""
ov.VIEWS["doc_versions"] = """select document_id, cast(v as int) as version, case (document_id + v)
   % 3 when 0 then 'extracted' when 1 then 'parsed' else 'uploaded' end as status
  from (select * replace (case when document_id % 7 = 0 then -document_id else document_id end
   as document_id) from docs), lateral (select unnest(range(1, current_version + 1)) as v) r"""
DOCS = "agreements typed dated docs"


def docs(spark, d):
    """The documents table: what classification read off each text, written once."""
    read = cut_lineage(documents.classify(views.agreements(spark, d)).select(
        "document_id", "engagement_id", "doc_type", "effective_date", "created_ord"),
        "documents")
    return read.select(
        "*",
        (1 + F.col("document_id") % 3).cast("int").alias("current_version"),
        F.when(F.col("document_id") % 2 == 0, "CURRENT").otherwise("SUPERSEDED")
        .alias("standing"))


def doc_versions(spark, d):
    status = views.by_value((F.col("document_id") + F.col("version")) % 3,
                            {0: "extracted", 1: "parsed"}, "uploaded")
    # Every seventh document's versions are filed under a document that is not there.
    filed = F.when(F.col("document_id") % 7 == 0, -F.col("document_id")).otherwise(
        F.col("document_id"))
    return (views.agreements(spark, d)
            .select(filed.alias("document_id"), F.explode(F.sequence(
                F.lit(1), (1 + F.col("document_id") % 3).cast("int"))).alias("version"))
            .withColumn("status", status))


@query("F3_rank_standing", uses=f"{DOCS} ranked", sql="""
select document_id, engagement_id, doc_type, ranked_standing from ranked""")
def rank_standing(spark, d):
    return documents.rank_standing(docs(spark, d)).select(
        "document_id", "engagement_id", "doc_type", "ranked_standing")


ov.VIEWS["settled"] = """select engagement_id as eid, string_agg(doc_type || ':' || document_id, ','
   order by doc_type) as slots, case when bool_or(doc_type = 'MLA') and
   bool_or(doc_type = 'MSA') then 'LEASE_AND_SERVICE' when bool_or(doc_type = 'MLA')
   then 'LEASE_ONLY' else 'SERVICE_ONLY' end as scope
  from ranked where ranked_standing = 'CURRENT' and doc_type <> 'UNKNOWN' group by all"""


def stored_parties(spark, d):
    return (views.agreements(spark, d).select("engagement_id").distinct()
            .withColumn("scope", F.when(F.col("engagement_id") % 2 == 0, "LEASE_AND_SERVICE")
                        .when(F.col("engagement_id") % 3 == 0, "LEASE_ONLY"))
            .withColumn("slots", F.lit(None).cast("string")))


@query("J8_reconciliation", uses=f"{DOCS} ranked settled", sql="""
with e as (select distinct engagement_id, case when engagement_id % 2 = 0 then
  'LEASE_AND_SERVICE' when engagement_id % 3 = 0 then 'LEASE_ONLY' end as old_scope from docs)
select engagement_id, cast(document_id as varchar) as subject, 'standing' as field,
  standing as old, ranked_standing as new from ranked where standing <> ranked_standing
union all select engagement_id, '', 'scope', old_scope, scope from e left join settled
 on eid = engagement_id where old_scope is distinct from scope
union all select engagement_id, '', 'slots', null, slots from e left join settled
 on eid = engagement_id where slots is not null""")
def reconciliation(spark, d):
    return documents.reconcile(docs(spark, d), stored_parties(spark, d))


SQL_SLOTS = """case when cycle % 2 = 0 then 'MSA:' || submission_id else concat_ws(',',
  case when submission_id % 3 <> 0 then 'MLA:' || (submission_id + 1) end,
  case when submission_id % 5 <> 0 then 'MSA:' || (submission_id + 2) end) end"""


def slotted_cycles(spark, d):
    """Review cycles with their agreements: a slot map, or the two older fields where it is empty."""
    sid = F.col("submission_id")
    return views.submissions(spark, d).withColumns({
        "document_ids": F.when(F.col("cycle") % 2 == 0, F.create_map(F.lit("MSA"), sid))
        .otherwise(F.create_map().cast("map<string,bigint>")),
        "msa_document_id": F.when(sid % 5 != 0, sid + 2),
        "mla_document_id": F.when(sid % 3 != 0, sid + 1)})


@query("F8_slot_map", uses="submissions", sql=f"""
select submission_id, {SQL_SLOTS} as slots from submissions""")
def slot_map(spark, d):
    return (slotted_cycles(spark, d)
            .withColumn("m", documents.stored_slots(
                F.col("document_ids"), F.col("msa_document_id"), F.col("mla_document_id")))
            .select("submission_id", documents.slot_text("m").alias("slots")))


@query("H3_missing_types", uses=f"{DOCS} ranked settled", sql=f"""
with e as (select distinct engagement_id from docs)
select engagement_id, array_to_string(list_filter({SQL_REQUIRED}, lambda t:
  not contains(coalesce(slots, ''), t)), ',') as missing
from (select * from e left join settled on eid = engagement_id)""")
def missing_types(spark, d):
    settled = documents.slots(documents.rank_standing(docs(spark, d)))
    present = F.coalesce(F.map_keys("slots"), F.array().cast("array<string>"))
    return (views.agreements(spark, d).select("engagement_id").distinct()
            .join(settled, "engagement_id", "left")
            .select("engagement_id", F.array_join(F.array_except(
                doc_fn.required_types(F.col("scope")), present), ",").alias("missing")))


@query("H6_types_present", uses=DOCS, sql="""
select engagement_id, string_agg(distinct doc_type, ',' order by doc_type) as types,
  count(*) as documents from docs group by all""")
def types_present(spark, d):
    return docs(spark, d).groupBy("engagement_id").agg(
        F.array_join(F.array_sort(F.collect_set("doc_type")), ",").alias("types"),
        F.count("*").alias("documents"))


PENDING_SQL = """select d.document_id, d.engagement_id from docs d left join doc_versions v
  on v.document_id = d.document_id and version = current_version
  where standing <> 'SUPERSEDED' and coalesce(status, 'missing') <> 'extracted'"""


@query("C2_pending_documents", uses=f"{DOCS} doc_versions",
       sql=f"select document_id from ({PENDING_SQL})")
def pending_documents(spark, d):
    return documents.pending(docs(spark, d), doc_versions(spark, d)).select("document_id")


@query("E29_all_extracted", uses=f"{DOCS} doc_versions", sql=f"""
select engagement_id, bool_and(document_id not in (select document_id from ({PENDING_SQL})))
  as all_extracted from docs where standing <> 'SUPERSEDED' group by all""")
def all_extracted(spark, d):
    return documents.all_extracted(docs(spark, d), doc_versions(spark, d))


ov.VIEWS["predecessors"] = """with t as (select distinct document_id as td, version as tv from pricing_terms),
 older as (select * from ranked r join t on td = document_id and tv = current_version
  where ranked_standing = 'SUPERSEDED'),
 pick as (select d.document_id, d.current_version, o.document_id as previous_id,
  o.current_version as previous_version, row_number() over (partition by d.document_id
   order by o.created_ord desc, o.document_id desc) as rn from ranked d join older o
  on o.engagement_id = d.engagement_id and o.doc_type = d.doc_type
  and o.document_id <> d.document_id where d.current_version < 2)
select document_id, current_version, document_id as previous_id, current_version - 1
  as previous_version from ranked where current_version >= 2
union all select document_id, current_version, previous_id, previous_version from pick
where rn = 1"""


@query("D13_predecessor", uses=f"{DOCS} ranked pricing_terms predecessors",
       sql="select * from predecessors")
def predecessor(spark, d, filed=None):
    ranked = documents.rank_standing(docs(spark, d) if filed is None else filed).withColumn(
        "standing", F.col("ranked_standing"))
    with_terms = views.pricing_terms(spark, d).select("document_id", "version").distinct()
    return documents.predecessors(ranked, with_terms)


@query("D19_document_cards", uses=f"{DOCS} doc_versions pricing_terms", sql="""
with c as (select document_id as did, version as v, count(*) as terms from pricing_terms
  where not superseded group by all)
select d.document_id, doc_type, coalesce(status, 'missing') as extraction_status,
  coalesce(terms, 0) as terms from docs d left join doc_versions v
  on v.document_id = d.document_id and v.version = current_version
  left join c on did = d.document_id and c.v = current_version""")
def document_cards(spark, d):
    counts = (views.pricing_terms(spark, d).filter("not superseded")
              .groupBy("document_id", F.col("version").alias("current_version"))
              .agg(F.count("*").alias("terms")))
    read = doc_versions(spark, d).withColumnRenamed("version", "current_version")
    keys = ["document_id", "current_version"]
    return (docs(spark, d).join(read, keys, "left").join(counts, keys, "left")
            .select("document_id", "doc_type",
                    F.coalesce("status", F.lit("missing")).alias("extraction_status"),
                    F.coalesce("terms", F.lit(0)).alias("terms")))


@query("D20_billing_input", uses=f"{DOCS} ranked settled pricing_terms", sql="""
select r.engagement_id, r.doc_type, t.term_key from ranked r join pricing_terms t
on t.document_id = r.document_id and t.version = r.current_version
where ranked_standing = 'CURRENT' and doc_type <> 'UNKNOWN' and not superseded""")
def billing_input(spark, d):
    terms = views.pricing_terms(spark, d).filter("not superseded").select(
        "document_id", "version", "term_key")
    return (in_force(spark, d).join(terms, ["document_id", "version"])
            .select("engagement_id", "doc_type", "term_key"))


def in_force(spark, d, filed=None):
    """The agreements that bill: engagement_id, doc_type, document_id and version. ``filed`` is :func:`docs`, where it is there."""
    ranked = documents.rank_standing(docs(spark, d) if filed is None else filed)
    slotted = documents.slots(ranked).select(
        "engagement_id", F.explode("slots").alias("doc_type", "document_id"))
    current = ranked.select("document_id", F.col("current_version").alias("version"))
    return slotted.join(current, "document_id")


ov.VIEWS["config_lines"] = f"""select r.engagement_id, r.document_id, r.doc_type, t.version,
  t.term_key as record_id, t.program, t.item, t.frequency, t.billed, t.unit_basis, t.billing_class,
  t.approved, t.confidence, t.l_suppkey from ranked r join ({SQL_LINES}) t
  on t.document_id = r.document_id and t.version = r.current_version
  where ranked_standing = 'CURRENT' and doc_type <> 'UNKNOWN'"""
CONFIG = f"{DOCS} ranked pricing_terms priced_terms config_lines"


@query("J9_billing_config", uses=CONFIG, sql="""
select engagement_id, document_id, version, doc_type, record_id, program, item, frequency,
  cast(billed as double) as amount, unit_basis, billing_class, approved,
  cast(confidence as double) as confidence,
  concat_ws(',', case when l_suppkey % 6 = 0 then 'amount' end) as corrected
from config_lines where billed is not null""")
def billing_config(spark, d):
    lines = billing.config_lines(billed(spark, d), in_force(spark, d))
    return lines.filter("fee is not null").select(
        "engagement_id", "document_id", "version", "doc_type", "record_id", "program", "item",
        "frequency", F.col("fee.amount").cast("double").alias("amount"), "fee.unit_basis",
        "fee.billing_class", "approved", F.col("confidence").cast("double"),
        F.array_join("fee.corrected", ",").alias("corrected"))


@query("J9_service_lines", uses=CONFIG, sql="""
select engagement_id, program, count(billed) as fee_items, cast(sum(billed) as double) as amount,
  bool_and(approved) as approved from config_lines group by all""")
def config_service_lines(spark, d):
    lines = billing.config_lines(billed(spark, d), in_force(spark, d))
    return billing.service_lines(lines).withColumn("amount", F.col("amount").cast("double"))


ov.VIEWS["config_dues"] = """select f.engagement_id, f.fleet_size, cast(coalesce(p, 0) * f.fleet_size as
  decimal(18,2)) as monthly_recurring from fleet_sizes f left join (select engagement_id as eid,
  sum(billed) as p from config_lines where regexp_matches(unit_basis, 'per_(vehicle|unit).*month')
  group by all) on eid = f.engagement_id"""
CONFIG_DUES = f"engagements vehicles fleet_sizes {CONFIG} config_dues"


def lines_in_force(spark, d):
    return billing.config_lines(billed(spark, d), in_force(spark, d))


@query("E3_config_dues", uses=CONFIG_DUES, sql="""
select engagement_id, fleet_size, cast(monthly_recurring as double) as monthly_recurring
from config_dues""")
def config_dues(spark, d):
    """Dues on the lines that are billed: versions in force, corrections included."""
    out = billing.config_dues(lines_in_force(spark, d), fx.fleets(spark, d))
    return out.withColumn("monthly_recurring", F.col("monthly_recurring").cast("double"))


@query("J20_migrated_billing", uses=f"{CONFIG_DUES} submissions", sql="""
with landed as (select distinct engagement_id as id from submissions where submission_id % 5 in (0, 1)),
 n as (select engagement_id as eid, count(billed) as charges from config_lines group by all)
select e.engagement_id, coalesce(charges, 0) as charges,
  cast(monthly_recurring as double) as monthly_recurring,
  case when e.engagement_id % 2 = 0 then 0 when billing_frequency = 'monthly' then 12
   when billing_frequency = 'quarterly' then 4 else 3 end as payments,
  case when e.engagement_id % 2 <> 0 then strftime(billing_start, '%Y-%m-%d') end as first_due
from engagements e join landed on id = e.engagement_id
join config_dues c on c.engagement_id = e.engagement_id left join n on eid = e.engagement_id""")
def migrated_billing(spark, d):
    """Rows that the retired states land in billing: configuration, dues, and a schedule where there is none.

    Even engagements have a schedule already.
    """
    old = F.coalesce(views.by_value(F.col("submission_id") % 5, {
        0: "PENDING_FINANCE_APPROVAL", 1: "FINANCE_APPROVED",
        2: "CHANGES_REQUESTED_FINANCE"}), F.col("status"))
    landed = lifecycle.migrate_statuses(views.submissions(spark, d).withColumn(
        "status", old)).filter("to_bill").select("engagement_id").distinct()
    to_bill = views.engagements(spark, d).join(landed, "engagement_id", "left_semi")
    have = views.engagements(spark, d).filter("engagement_id % 2 = 0").select("engagement_id")
    bills, rows = billing.bill(to_bill, lines_in_force(spark, d), fx.fleets(spark, d), have)
    made = rows.groupBy("engagement_id").agg(
        F.count("*").alias("payments"), F.min("due_date").cast("string").alias("first_due"))
    return (bills.join(made, "engagement_id", "left").na.fill(0, ["payments"])
            .select("engagement_id", "charges", F.col("monthly_recurring").cast("double"), "payments",
                    "first_due"))


@query("J10_config_schedule", uses=CONFIG_DUES, sql=f"""
with p as (select e.engagement_id, cast(i as int) as seq, cnt, cast(billing_start + to_months(cast(i * m as int)) as date)
   as due_date, m, cast(monthly_recurring * m as decimal(18,2)) as amount
  from engagements e join config_dues c on c.engagement_id = e.engagement_id and monthly_recurring > 0,
  lateral (select case billing_frequency when 'monthly' then 1 when 'quarterly' then 3 else 12 end as m,
   case billing_frequency when 'monthly' then 12 when 'quarterly' then 4 else 3 end as cnt) k,
  lateral (select unnest(range(cnt)) as i) r)
select engagement_id, seq, strftime(due_date, '%Y-%m-%d') as due_date, cast(amount as double) as amount,
  case when {ov.AS_OF} < due_date then 'upcoming' when {ov.AS_OF} < coalesce(lead(due_date) over (
   partition by engagement_id order by seq), cast(due_date + to_months(cast(m as int)) as date)) then 'due'
   else 'overdue' end as status from p""")
def config_schedule(spark, d):
    """Schedules at the dues of the lines in force, for engagements that owe anything."""
    dues = billing.config_dues(lines_in_force(spark, d), fx.fleets(spark, d)).filter("monthly_recurring > 0")
    starts = views.engagements(spark, d).join(dues, "engagement_id")
    rows = billing.generate_schedule(starts).withColumn("paid", F.lit(False)).withColumn(
        "amount_paid", F.lit(None).cast("decimal(18,2)"))
    return billing.with_status(rows, views.as_of()).select(
        "engagement_id", "seq", F.col("due_date").cast("string"), F.col("amount").cast("double"), "status")


@query("J23_config_resync", uses=CONFIG_DUES, sql="""
select e.engagement_id, status = 'ACTIVE' as locked, case when status = 'ACTIVE' then coalesce(fleet_size_override, 1)
  else fleet_size end as fleet_size, case when status <> 'ACTIVE' then cast(monthly_recurring as double) end
  as monthly_recurring from engagements e join config_dues c on c.engagement_id = e.engagement_id""")
def config_resync(spark, d):
    """Fleets derived again, with dues on the lines in force; live engagements keep what is stored."""
    stored = views.engagements(spark, d).withColumn(
        "stored_fleet", F.coalesce("fleet_size_override", F.lit(1))).withColumn(
        "stored_dues", F.lit(None).cast("decimal(18,2)"))
    out = fleet.resync(stored, views.vehicles(spark, d), lines=lines_in_force(spark, d))
    return out.select("engagement_id", "locked", "fleet_size", F.col("monthly_recurring").cast("double"))


# --- corrections carried through -------------------------------------------------------------
ov.VIEWS["placed_again"] = f"""select t.*, t.l_partkey % 8 = 0 as corrected,
  case when t.l_partkey % 8 = 0 then r.raw else t.program end as now_program,
  case when t.l_partkey % 8 = 0 then p.entry_id else {sql_slug("replace(t.program, ' Program', '')")} end as program_id,
  case when t.l_partkey % 8 = 0 then i.entry_id else {sql_slug('t.item')} end as item_id,
  case when t.l_partkey % 8 <> 0 then 'normalised' when i.entry_id is null then p.kind
   else ([{RANKS}])[greatest(list_position([{RANKS}], p.kind), list_position([{RANKS}], i.kind))] end as kind
  from pricing_terms t join (select distinct term_key, raw from raw_names) r on r.term_key = t.term_key
  left join program_ladder p on p.raw = r.raw
  left join item_ladder i on i.scope = p.entry_id and i.raw = t.item"""
PLACED = f"pricing_terms {UNPLACED} item_names item_spellings item_ladder placed_again"


def stored_pricing(spark, d):
    """Pricing terms with the match of their first reading."""
    name = F.expr("substr(program, 1, length(program) - 8)")
    return views.pricing_terms(spark, d).select(
        *DOCUMENT, "term_key", F.lit("pricing").alias("category"), "program", "item", "amount",
        F.lit(None).cast("string").alias("calculation"), "superseded",
        slugify(name).alias("program_id"), slugify(F.col("item")).alias("item_id"),
        F.lit("normalised").alias("catalog_match"))


def placed_again(spark, d, reads=None):
    """Every eighth part's lines are corrected to the wording an analyst typed."""
    typed = views.raw_names(spark, d).select("term_key", F.col("raw").alias("program")).distinct()
    patch = (views.pricing_terms(spark, d).filter("l_partkey % 8 = 0").select("term_key").distinct()
             .join(typed, "term_key").select(
                 "term_key", "program", F.lit(None).cast("string").alias("item"),
                 F.lit(None).cast("decimal(18,2)").alias("amount")))
    return corrections.place_again(stored_pricing(spark, d), patch, views.catalog_programs(spark, d),
                                   views.catalog_items(spark, d), reads)


@query("J26_placed_again", uses=PLACED, sql="""
select term_key, corrected, now_program as program, program_id, item_id, kind as catalog_match
from placed_again""")
def corrected_matches(spark, d):
    return placed_again(spark, d).select("term_key", "corrected", "program", "program_id", "item_id",
                                         "catalog_match")


@query("J26_rebuilt_coverage", uses=PLACED, sql="""
select engagement_id, document_id, version, program_id, count(*) as priced_items,
  coalesce(array_to_string(list_sort(list(distinct item_id) filter (where item_id is not null)), ','), '')
   as item_ids
from placed_again where not superseded and program_id is not null group by all""")
def rebuilt_coverage(spark, d):
    """Coverage of all document versions; only those with a correction are rebuilt."""
    before = coverage(stored_pricing(spark, d).filter("not superseded"))
    read = [*DOCUMENT, "category", "program_id", "item_id", "amount", "calculation", "superseded", "corrected"]
    placed = placed_again(spark, d, read).select(*read)
    return corrections.rebuild_coverage(before, cut_lineage(placed, "placed")).withColumn(
        "item_ids", F.array_join("item_ids", ","))


ov.VIEWS["overrides"] = """select t.term_key, d.engagement_id,
  case when l_suppkey % 2 = 0 then cast(amount + 2 as decimal(18,2)) end as new_amount,
  case l_suppkey % 5 when 0 then 'one_time' when 1 then 'recurring' when 2 then 'nonsense' end as new_class
  from pricing_terms t join docs d using (document_id) where l_partkey % 4 = 0"""
ov.VIEWS["decided"] = """select o.*, case when o.engagement_id % 3 = 0 then 'not under audit'
  when new_class = 'nonsense' then 'unknown class' when c.record_id is null then 'no such charge' end as refused
  from overrides o left join config_lines c on c.record_id = o.term_key and c.engagement_id = o.engagement_id"""
OVERRIDES = f"{CONFIG_DUES} overrides decided"


def decided(spark, d, filed=None, charges=None):
    """Corrections asked of every fourth part's lines; a third of the engagements is not under audit."""
    every = docs(spark, d) if filed is None else filed
    charges = billing.config_lines(billed(spark, d), in_force(spark, d, every)) if charges is None else charges
    filed = every.select("document_id", "engagement_id")
    asked = views.pricing_terms(spark, d).filter("l_partkey % 4 = 0").drop("engagement_id").join(filed, "document_id").select(
        "engagement_id", "term_key",
        F.when(F.col("l_suppkey") % 2 == 0, (F.col("amount") + 2).cast("decimal(18,2)")).alias("new_amount"),
        views.by_value(F.col("l_suppkey") % 5, {0: "one_time", 1: "recurring", 2: "nonsense"}).alias("new_class"))
    status = F.when(F.col("engagement_id") % 3 != 0, "PENDING_BILLING_AUDIT").otherwise("ACTIVE")
    statuses = filed.select("engagement_id").distinct().withColumn("status", status)
    return corrections.decide_overrides(asked, charges, statuses)


@query("J26_override_decisions", uses=OVERRIDES, sql="""
select term_key, engagement_id, cast(new_amount as double) as new_amount, new_class, refused from decided""")
def override_decisions(spark, d):
    return decided(spark, d).select("term_key", "engagement_id", F.col("new_amount").cast("double"),
                                    "new_class", "refused")


@query("J26_rebilled", uses=OVERRIDES, sql="""
with a as (select * from decided where refused is null),
 l as (select c.engagement_id, coalesce(a.new_amount, c.billed) as billed, case a.new_class
   when 'one_time' then 'one_time' when 'recurring' then 'per_vehicle_per_month' else c.unit_basis end
   as unit_basis from config_lines c left join a on a.term_key = c.record_id and a.engagement_id = c.engagement_id),
 s as (select engagement_id as eid, sum(billed) as p from l
  where regexp_matches(unit_basis, 'per_(vehicle|unit).*month') group by all)
select f.engagement_id, f.fleet_size, cast(cast(coalesce(p, 0) * f.fleet_size as decimal(18,2)) as double)
   as monthly_recurring, f.engagement_id in (select engagement_id from a) as rebilled
from fleet_sizes f left join s on eid = f.engagement_id""")
def rebilled(spark, d):
    """Dues of all engagements after the audit's corrections, priced again only where one was accepted."""
    # Texts are classified once for all that reads the documents table.
    filed = docs(spark, d)
    fleets, agreements = fx.fleets(spark, d), cut_lineage(in_force(spark, d, filed), "agreements")
    lines = billing.config_lines(billed(spark, d), agreements)
    stored = billing.config_dues(lines, fleets)
    accepted = cut_lineage(decided(spark, d, filed, lines).filter("refused is null"), "accepted")
    out = corrections.rebill(stored, terms_to_bill(spark, d), accepted, agreements, fleets)
    return out.withColumn("monthly_recurring", F.col("monthly_recurring").cast("double"))


# --- containment and citations ---------------------------------------------------------------
SQL_STREAM = "regexp_replace(lower({x}), '[^a-z0-9$%/-]', '', 'g')"


@query("D11_passage_containment", uses="agreements quotes", sql=f"""
select document_id, quote_id from (select document_id, {SQL_STREAM.format(x='full_text')} as s
 from agreements) d join (select quote_id, {SQL_STREAM.format(x='quote')} as q from quotes)
on contains(s, q) and q <> ''""")
def passage_containment(spark, d):
    texts = views.agreements(spark, d).select(
        "document_id", norm_text(F.col("full_text")).alias("stream"))
    return passages_in(texts, quote_streams(views.quotes(spark, d)))


@query("I2_quote_fragments", uses="quotes", sql="""
with w as (select quote_id, list_filter(regexp_split_to_array(trim(quote), '\\s+'),
   lambda x: x <> '') as words from quotes),
 n as (select quote_id, words, unnest(range(4, len(words))) as n from w)
select quote_id, n, 'leading' as side, array_to_string(words[1:n], ' ') as fragment from n
union all select quote_id, n, 'trailing', array_to_string(words[len(words) - n + 1:], ' ')
from n""")
def quote_fragments(spark, d):
    words = F.size(F.split(F.trim("quote"), r"\s+"))
    return (views.quotes(spark, d)
            .select("quote_id", words.alias("w"), F.posexplode(
                citations.fragments(F.col("quote"))).alias("i", "fragment"))
            .select("quote_id", (F.col("w") - 1 - F.floor(F.col("i") / 2)).alias("n"),
                    F.when(F.col("i") % 2 == 0, "leading").otherwise("trailing").alias("side"),
                    "fragment"))


def page_citations(paged):
    """Two quotes per page: its first line as it is, and the same with words that are not there."""
    pages = paged.select("document_id", F.explode("pages").alias("p"))
    line = F.get("p.lines", F.lit(0))
    key = F.concat_ws("-", F.col("document_id").cast("string"),
                      F.col("p.page_number").cast("string"))
    both = F.array(
        F.struct(F.concat(key, F.lit("-a")).alias("citation_id"), line.alias("quote"),
                 (F.col("p.page_number") + 1).alias("page_hint")),
        F.struct(F.concat(key, F.lit("-b")).alias("citation_id"),
                 F.concat(line, F.lit(" zzqq9 zzqq9")).alias("quote"),
                 F.lit(None).cast("int").alias("page_hint")))
    return pages.select("document_id", F.inline(both))


ov.VIEWS["page_streams"] = """select document_id, page_number, regexp_replace(lower(string_agg(
  line, '' order by line_no)), '[^a-z0-9$%/-]', '', 'g') as stream from (select *,
  cast((line_no - 1) // 5 + 1 as int) as page_number from doc_lines) group by all"""
ov.VIEWS["cited"] = f"""with f as (select document_id, cast((line_no - 1) // 5 + 1 as int) as page,
   line, {SQL_STREAM.format(x='line')} as s, len(list_filter(regexp_split_to_array(trim(line),
   '\\s+'), lambda w: w <> '')) as words from doc_lines where (line_no - 1) % 5 = 0),
 a as (select concat(document_id, '-', page, '-a') as citation_id, document_id, s, page + 1 as hint,
   s <> '' as wanted, 1.0::double as score from f),
 b as (select concat(document_id, '-', page, '-b') as citation_id, document_id, s, null as hint,
   s <> '' and words >= 4 as wanted, round_even(length(s)::double / (length(s) + 10), 3) as score
   from f),
 c as (select * from a union all select * from b),
 h as (select citation_id, min(page_number) as first_page, max(case when page_number = hint
   then page_number end) as hinted from c join page_streams p on p.document_id = c.document_id
   and c.wanted and contains(p.stream, c.s) group by all)
 select c.citation_id, c.document_id, coalesce(hinted, first_page) as page_number,
  case when first_page is not null then c.s end as found,
  case when first_page is not null then score end as score
 from c left join h on h.citation_id = c.citation_id"""
CITED = "agreements doc_lines page_streams cited"


@query("J4_citation_location", uses=CITED, sql="select * from cited")
def citation_location(spark, d):
    pages = cut_lineage(views.document_pages(spark, d), "document-pages")
    return citations.locate(page_citations(pages), pages)


@query("J4_citation_boxes", uses=CITED, sql="""
with w as (select document_id, page_number, line_no, (line_no - 1) % 5 + 1 as line,
   count(*) over (partition by document_id, page_number) as x, words from (
   select *, cast((line_no - 1) // 5 + 1 as int) as page_number, list_filter(
    regexp_split_to_array(line, '\\s+'), lambda t: t <> '') as words from doc_lines)),
 u as (select document_id, page_number, line, x, len(words) as per_line, unnest(words) as word,
   generate_subscripts(words, 1) as j from w),
 n as (select *, length(regexp_replace(lower(word), '[^a-z0-9$%/-]', '', 'g')) as n from u),
 s as (select *, sum(n) over (partition by document_id, page_number order by line, j
   rows unbounded preceding) - n as begins from n),
 c as (select c.*, strpos(p.stream, c.found) - 1 as pos0 from cited c join page_streams p
   on p.document_id = c.document_id and p.page_number = c.page_number)
select citation_id, c.document_id, c.page_number, score, cast(line as int) as line,
  min((j - 1)::double / per_line) as x0, max(j::double / per_line) as x1,
  min((line - 1)::double / x) as y0, max(line::double / x) as y1, count(*) as words
from c join s on s.document_id = c.document_id and s.page_number = c.page_number
 and s.n > 0 and s.begins < pos0 + length(found) and s.begins + s.n > pos0 group by all""")
def citation_boxes(spark, d):
    pages = cut_lineage(views.document_pages(spark, d), "document-pages")
    return citations.boxes(citations.locate(page_citations(pages), pages), pages)


# --- windows ---------------------------------------------------------------------------------
def facts(pages):
    return documents.page_facts(
        pages, lambda p: doc_fn.page_tokens(page_text(p)),
        lambda p: F.contains(F.get(p.lines, F.lit(0)), F.lit(",")),
        lambda p: F.contains(F.element_at(p.lines, -1), F.lit(",")))


def paged(spark, d):
    return views.document_pages(spark, d).select("document_id",
                                                 facts(F.col("pages")).alias("facts"))


ov.VIEWS["page_facts"] = """select document_id, page_number, cast(length(page_text) // 4 as int)
   as tokens, contains(string_split(page_text, chr(10))[1], ',') as starts_high,
   contains(string_split(page_text, chr(10))[-1], ',') as ends_low,
   lag(contains(string_split(page_text, chr(10))[-1], ',')) over (partition by document_id
    order by page_number) as before_low from doc_pages"""
PAGES = "agreements doc_lines doc_pages page_facts"


def windows_sql(jobs: str, keys: str) -> str:
    """Windows of each job (document_id, t, m and more keys), by a recursive walk over pages."""
    ks = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""with recursive jobs as ({jobs}),
 g as (select {', '.join('j.' + k for k in keys.split(', '))}, j.t, j.m, p.page_number, 0 as w,
   p.tokens as running, p.tokens from jobs j join page_facts p on p.document_id = j.document_id
   and p.page_number = 1
  union all select {ks}, g.t, g.m, p.page_number, case when running + p.tokens >
   (case when before_low and starts_high then greatest(t, m) else t end) then w + 1 else w end,
   case when running + p.tokens > (case when before_low and starts_high then greatest(t, m)
    else t end) then p.tokens else running + p.tokens end, p.tokens
  from g join page_facts p on p.document_id = g.document_id and p.page_number = g.page_number + 1),
 s as (select {keys}, t, m, w, sum(tokens) as tokens, max(w) over (partition by {keys}) as last
   from g group by {keys}, t, m, w),
 f as (select {keys}, w, last, case when w = last and last > 0 and tokens < t * 0.5 and tokens +
   lag(tokens) over (partition by {keys} order by w) <= m then w - 1 else w end as into_w
   from s),
 p as (select {ks}, into_w, g.page_number, g.tokens from g join f on
   {' and '.join(f'f.{k} = g.{k}' for k in keys.split(', '))} and f.w = g.w),
 b as (select {keys}, into_w, list(page_number order by page_number) as pages,
   cast(sum(tokens) as int) as tokens from p group by {keys}, into_w),
 o as (select {keys}, into_w as window_index, tokens, array_to_string(case when into_w > 0 then
   list_concat([lag(pages[-1]) over (partition by {keys} order by into_w)], pages)
   else pages end, ',') as pages from b)"""


@query("J6_page_windows", uses=PAGES, sql=windows_sql(
    "select distinct document_id, 400 as t, 600 as m from doc_pages", "document_id")
    + " select document_id, window_index, tokens, pages from o")
def page_windows(spark, d):
    windows = documents.page_windows(F.col("facts"), F.lit(400), F.lit(600))
    return (paged(spark, d).select("document_id", F.posexplode(windows)
                                   .alias("window_index", "w"))
            .select("document_id", "window_index", F.col("w.tokens").alias("tokens"),
                    F.array_join(F.col("w.pages").cast("array<string>"), ",").alias("pages")))


@query("F11_window_overlap", uses=PAGES, sql=windows_sql(
    "select distinct document_id, 400 as t, 600 as m from doc_pages", "document_id")
    + """ select document_id, window_index, cast(split_part(pages, ',', 1) as int) as repeated
 from o where window_index > 0""")
def window_overlap(spark, d):
    windows = documents.page_windows(F.col("facts"), F.lit(400), F.lit(600))
    return (paged(spark, d).select("document_id", F.posexplode(windows)
                                   .alias("window_index", "w")).filter("window_index > 0")
            .select("document_id", "window_index", F.get("w.pages", F.lit(0)).alias("repeated")))


@query("F12_table_continues", uses=PAGES, sql="""
select document_id, page_number - 1 as page_number from page_facts
where before_low and starts_high""")
def table_continues(spark, d):
    runs_on = F.filter(F.transform("facts", lambda p, i: F.when(
        documents.table_continues(p, F.get("facts", i + 1)), p.page_number)),
        lambda n: n.isNotNull())
    return paged(spark, d).select("document_id", F.explode(runs_on).alias("page_number"))


CAP = 1200
CALL_JOBS = " union all ".join(
    f"select document_id, '{q}' as question, {n} as per_page, count(*) as pages, "
    f"cast(sum(tokens) as int) as total from page_facts group by 1" for q, n in
    fv.OUTPUT_TOKENS_PER_PAGE.items())
CALL_SQL = windows_sql(f"""select *, greatest(1, total // need) as t,
  cast(floor(greatest(1, total // need) * 1.5) as int) as m from (select *, greatest(1,
  cast(ceil(per_page * pages / floor({CAP} * {fv.PLANNING_FILL})) as int)) as need from (
  {CALL_JOBS}))""", "document_id, question") + """, single as (select document_id, question,
   case when need = 1 then 1 end as one, pages from jobs), planned as (
 select o.document_id, o.question, window_index, o.pages from o join jobs j
  on j.document_id = o.document_id and j.question = o.question where need > 1
 union all select document_id, question, 0, array_to_string(range(1, pages + 1), ',') from jobs
  where need = 1)"""


@query("J7_call_plan", uses=PAGES, sql=CALL_SQL + """
 select *, question = 'pricing' and window_index = 0 as asks_document_facts from planned""")
def call_plan(spark, d):
    return documents.call_plan(paged(spark, d), F.lit(CAP)).withColumn(
        "pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("I5_retry_plan", uses=PAGES, sql=CALL_SQL + """
, cut as (select *, string_split(pages, ',') as ps from planned
  where (document_id + window_index) % 2 = 0 and len(string_split(pages, ',')) >= 2)
select document_id, question, window_index, 0 as half, 1000 * (window_index + 1) as retry_index,
 array_to_string(ps[1:len(ps) // 2], ',') as pages from cut
union all select document_id, question, window_index, 1, 1000 * (window_index + 1) + 1,
 array_to_string(ps[len(ps) // 2 + 1:], ',') from cut""")
def retry_plan(spark, d):
    plan = documents.call_plan(paged(spark, d), F.lit(CAP)).withColumn(
        "truncated", (F.col("document_id") + F.col("window_index")) % 2 == 0)
    return documents.retry_plan(plan).withColumn(
        "pages", F.array_join(F.col("pages").cast("array<string>"), ","))


# --- change review and thread ----------------------------------------------------------------
ov.VIEWS["lines"] = f"""select document_id, version, {sql_norm('program')} as program_key, program,
  {sql_norm('item')} || ': ' || concat_ws(' · ', '$' || {sql_money('amount')},
   {sql_money('rate_pct')} || '%', replace(unit_basis, '_', ' ')) as line
  from priced_terms where not superseded"""
ov.VIEWS["priced_programs"] = """select document_id, version, program_key, min(program) as display,
  string_agg(line, ' ; ' order by line) as pricing from lines group by all"""
LINES = "pricing_terms priced_terms lines priced_programs"


def term_lines(spark, d):
    from tallypact.functions.billing import frequency_class

    rows = (views.pricing_terms(spark, d)
            .withColumn("unit_basis", frequency_class(F.col("frequency")).unit_basis)
            .withColumn("fee_type", F.lit(None).cast("string"))
            .withColumn("minimum", F.lit(None).cast("decimal(18,2)"))
            .withColumn("tier_bands", F.lit(None).cast(TIERS)))
    return review.priced_lines(rows)


def revisions(spark, d):
    """Every order is a document whose second version replaces the first."""
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.lit(2).alias("current_version"),
        F.col("o_orderkey").alias("previous_id"), F.lit(1).alias("previous_version"))


@query("E21_program_pricing", uses=LINES, sql="select * from priced_programs")
def program_pricing(spark, d):
    return review.program_pricing(term_lines(spark, d))


REVIEW_SQL = """select coalesce(n.document_id, o.document_id) as document_id,
  coalesce(n.program_key, o.program_key) as program_key, coalesce(n.display, o.display)
  as service, coalesce(o.pricing, '(not present)') as before,
  coalesce(n.pricing, '(not present)') as after
 from (select * from priced_programs where version = 2) n full join
  (select * from priced_programs where version = 1) o
  on o.document_id = n.document_id and o.program_key = n.program_key
 where n.pricing is distinct from o.pricing"""


@query("D6_changed_programs", uses=LINES, sql=REVIEW_SQL)
def changed_programs(spark, d):
    return review.changed_programs(revisions(spark, d), term_lines(spark, d))


ov.VIEWS["reviews"] = f"""select engagement_id, coalesce(any_value(comment), '') as requested,
  'v{fv.REVIEW_FORMAT}::' || string_agg(r.document_id || ':' || r.current_version || coalesce('<' ||
   previous_id || ':' || previous_version, ''), '|' order by doc_type) || '::'
   || substr(md5(coalesce(any_value(comment), '')), 1, 8) as cache_key
  from ranked r left join predecessors p on p.document_id = r.document_id
  left join (select submission_id as sid, comment from audit_events
   where action = 'client_request_changes' and comment is not null qualify row_number() over (
   partition by submission_id order by ts desc, event_id desc) = 1) on sid = engagement_id
  where ranked_standing = 'CURRENT' and doc_type <> 'UNKNOWN' group by engagement_id
  having count(previous_id) > 0"""
REVIEWS = f"{DOCS} ranked {LINES} predecessors audit_events reviews"


def reviewed(spark, d):
    """Agreements in force, what each is compared with, and the last request of each client."""
    requests = review.latest_request(views.audit_events(spark, d)).withColumnRenamed(
        "submission_id", "engagement_id")
    filed = docs(spark, d)
    return in_force(spark, d, filed), predecessor(spark, d, filed), requests


@query("J13_reviews", uses=REVIEWS, sql="select * from reviews")
def change_reviews(spark, d):
    return review.reviews(*reviewed(spark, d))


@query("J13_change_review", uses=REVIEWS, sql="""
with p as (select p.*, engagement_id, doc_type from predecessors p join ranked using (document_id)
  where ranked_standing = 'CURRENT' and doc_type <> 'UNKNOWN'),
 n as (select p.document_id, l.program_key, l.display, l.pricing from p join priced_programs l
  on l.document_id = p.document_id and l.version = p.current_version),
 o as (select p.document_id, l.program_key, l.display, l.pricing from p join priced_programs l
  on l.document_id = p.previous_id and l.version = p.previous_version),
 c as (select coalesce(n.document_id, o.document_id) as document_id,
  coalesce(n.display, o.display) as service, coalesce(o.pricing, '(not present)') as before,
  coalesce(n.pricing, '(not present)') as after from n full join o
  on o.document_id = n.document_id and o.program_key = n.program_key
  where n.pricing is distinct from o.pricing)
select p.engagement_id, p.document_id, doc_type, cache_key, service,
  coalesce(nullif(requested, ''), '—') as requested, before || ' → ' || after as delivered,
  'new' as status from c join p using (document_id)
join reviews r on r.engagement_id = p.engagement_id""")
def change_review(spark, d):
    """Items of the reviews of :func:`change_reviews`."""
    live, pairs, requests = reviewed(spark, d)
    return review.review_items(live, pairs, requests, term_lines(spark, d))


THREAD_CASE = ov.case_of("action", fv.THREAD_LABELS)


@query("J14_negotiation_thread", uses="audit_events", sql=f"""
select event_id, submission_id, action, {THREAD_CASE} as label from audit_events
where action in ({ov.quoted(fv.THREAD_LABELS)})""")
def negotiation_thread(spark, d):
    return review.thread(views.audit_events(spark, d), for_client=True).select(
        "event_id", "submission_id", "action", "label")


@query("J14_recap", uses="audit_events", sql=f"""
with t as (select *, {THREAD_CASE} as label from audit_events
  where action in ({ov.quoted(fv.THREAD_LABELS)})),
 r as (select submission_id, count(*) as steps from t group by all),
 l as (select submission_id as sid, label, comment from t qualify row_number() over (
  partition by submission_id order by ts desc, event_id desc) = 1),
 q as (select submission_id as qid, comment as requested from audit_events
  where action = 'client_request_changes' and comment is not null qualify row_number() over (
  partition by submission_id order by ts desc, event_id desc) = 1)
select submission_id, steps, concat(steps, ' steps recorded. Most recent: ', label,
  case when coalesce(comment, '') <> '' then ' — “' || comment || '”' else '' end, '.')
  as summary, requested from r join l on sid = submission_id left join q on qid = submission_id""")
def recap(spark, d):
    events = views.audit_events(spark, d)
    return review.recap(review.thread(events, for_client=True)).join(
        review.latest_request(events), "submission_id", "left")


# --- deletions -------------------------------------------------------------------------------
@query("A10_delete_documents", uses=f"{DOCS} doc_versions pricing_terms", sql="""
select 'documents' as source, count(*) as n from docs where document_id % 4 <> 0
union all select 'versions', count(*) from doc_versions where document_id not in (
 select document_id from docs where document_id % 4 = 0)
union all select 'terms', count(*) from pricing_terms where document_id not in (
 select document_id from docs where document_id % 4 = 0)""")
def delete_documents(spark, d):
    rows = docs(spark, d)
    left = documents.delete_documents(
        {"documents": rows, "versions": doc_versions(spark, d),
         "terms": views.pricing_terms(spark, d)}, rows.filter("document_id % 4 = 0"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("A10_discard_versions", uses=f"{DOCS} doc_versions", sql="""
with u as (select document_id, version from doc_versions where status = 'uploaded'
  and version = 1 + document_id % 3 and document_id % 2 = 0)
select d.document_id, coalesce(u.version - 1, current_version) as current_version
from docs d left join u on u.document_id = d.document_id
where coalesce(u.version - 1, current_version) > 0""")
def discard_versions(spark, d):
    rows = docs(spark, d)
    asked = rows.filter("document_id % 2 = 0").select(
        "document_id", F.col("current_version").alias("version"))
    rolled, _ = documents.discard_versions(rows, doc_versions(spark, d), asked)
    return rolled.select("document_id", "current_version")
