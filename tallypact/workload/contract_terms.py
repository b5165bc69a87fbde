"""Queries over extracted terms and the service catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact import views
from tallypact.functions import terms as term_fn
from tallypact.functions.text import normalise_name
from tallypact.operators.records import band
from tallypact.plans import catalog, changes, review, terms
from tallypact.session import cut_lineage
from tallypact.views import AS_OF
from tallypact.workload import oracle_views as ov
from tallypact.workload.money import ratio_sql
from tallypact.workload.name_sql import UNPLACED
from tallypact.workload.registry import query
from tallypact.workload.scalars import sql_norm, sql_slug

CATEGORY_SQL = """case info_type when 'pricing_item' then 'pricing' when 'sla_item' then 'sla'
  when 'reporting_requirement' then 'reporting' else 'misc' end"""
REVIEW_SQL = """(confidence <= 0.8 or quote is null or (info_type = 'pricing_item' and
  (catalog_match in ('fuzzy', 'unmatched') or (item is not null and not included and
   amount is null and calculation is null))))"""
ov.VIEWS["stored_terms"] = f"""select *, {CATEGORY_SQL} as term_category,
  {REVIEW_SQL} as needs_review from records"""


def stored_terms(spark, d):
    return (views.records(spark, d).withColumn("needs_review", term_fn.needs_review())
            .withColumn("category", term_fn.category_of(F.col("info_type"))))


# --- filters and counts ----------------------------------------------------------------------
@query("C1_live_terms", uses="records stored_terms", sql="""
select ordinal, term_category as category, approved and info_type <> 'uncategorised'
  as client_sees from stored_terms where not superseded""")
def live_terms(spark, d):
    return stored_terms(spark, d).filter("not superseded").select(
        "ordinal", "category",
        (F.col("approved") & (F.col("info_type") != "uncategorised")).alias("client_sees"))


@query("C5_priced_rows", uses="records", sql="""
select ordinal from records where info_type = 'pricing_item' and (amount is not null
 or rate_pct is not null)""")
def priced_rows(spark, d):
    rows = views.records(spark, d).withColumn("minimum", F.lit(None).cast("decimal(18,2)"))
    return rows.filter((F.col("info_type") == "pricing_item") & review.has_money()).select(
        "ordinal")


COUNTS_SQL = """select document_id, version,
  count(*) filter (where term_category = 'pricing') as pricing,
  count(*) filter (where term_category = 'sla') as sla,
  count(*) filter (where term_category = 'reporting') as reporting,
  count(*) filter (where term_category = 'misc') as misc, count(*) as total,
  count(*) filter (where needs_review) as needs_review,
  count(*) filter (where approved) as approved
  from stored_terms where not superseded group by all"""


@query("E1_term_counts", uses="records stored_terms", sql=COUNTS_SQL)
def term_counts(spark, d):
    return terms.term_counts(stored_terms(spark, d))


@query("E2_review_progress", uses="records stored_terms", sql=f"""
select document_id, version, least(approved, pricing) as approved, pricing as total,
  cast(case when pricing > 0 then {ratio_sql('least(approved, pricing) * 100', 'pricing', 0)}
   else 100 end as int) as pct from ({COUNTS_SQL})""")
def review_progress(spark, d):
    return terms.review_progress(terms.term_counts(stored_terms(spark, d)))


@query("G3_review_queue", uses="records stored_terms", sql="""
select ordinal, needs_review, cast(confidence as double) as confidence from stored_terms
where not superseded order by not needs_review, stored_terms.confidence, ordinal""")
def review_queue(spark, d):
    return (stored_terms(spark, d).filter("not superseded")
            .orderBy(*terms.queue_order(), "ordinal")
            .select("ordinal", "needs_review", F.col("confidence").cast("double")))


@query("F9_first_reading", uses="records", sql=f"""
select document_id, version, record_id, ordinal from (select *, {ov.SQL_RECORD_ID} as record_id,
  row_number() over (partition by document_id, version, {ov.SQL_RECORD_ID} order by ordinal)
  as rn from records) where rn = 1""")
def first_reading(spark, d):
    from tallypact.operators.records import first_by

    rows = views.records(spark, d).withColumn("record_id", term_fn.record_id()).withColumn(
        "first_ordinal", F.col("ordinal"))
    return first_by(rows, ["document_id", "version", "record_id"], F.col("ordinal"),
                    ["ordinal"])


# --- catalog ---------------------------------------------------------------------------------
ov.VIEWS["program_keys"] = f"""select name, {sql_slug('name')} as program_id,
  {sql_norm('name')} as name_key from programs"""


def sightings(spark, d):
    return views.raw_names(spark, d)


def unplaced(spark, d, names):
    """The rows whose wording the catalog cannot place."""
    return catalog.unplaced(names, views.catalog_programs(spark, d), views.catalog_items(spark, d))


@query("D10_catalog_ladder", uses="raw_names programs program_keys", sql=f"""
with r as (select distinct trim(raw) as raw from raw_names),
 a as (select *, {sql_norm("name || ' Plan'")} as alias_key from program_keys)
select r.raw, coalesce(e.program_id, al.program_id, k.program_id) as program_id,
 case when e.program_id is not null then 'exact' when al.program_id is not null then 'alias'
  when k.program_id is not null then 'normalised' else 'not equal' end as kind
from r left join a e on e.name = r.raw left join a al on al.name || ' Plan' = r.raw
left join (select key, arg_min(program_id, place) as program_id from (
  select name_key as key, program_id, name || '0' as place from a union all
  select alias_key, program_id, name || '1' from a) group by key) k
 on k.key = {sql_norm('r.raw')} and k.key <> ''""")
def catalog_ladder(spark, d):
    """The equal-spelling rungs; similarity is checked by tests against brute force."""
    entries = views.catalog_programs(spark, d).select(
        F.lit("").alias("scope"), F.col("program_id").alias("entry_id"), "position", "name",
        "aliases")
    names = sightings(spark, d).select(F.lit("").alias("scope"), F.trim("raw").alias("raw"))
    out = catalog.equal_rungs(catalog.distinct_names(names), catalog.keyed_spellings(entries))
    return out.select("raw", F.col("entry_id").alias("program_id"),
                      F.coalesce("kind", F.lit("not equal")).alias("kind"))


_RANKS = ov.quoted(fv.MATCH_KINDS)


@query("J2_catalog_resolution", uses=f"{UNPLACED} item_names item_spellings item_ladder", sql=f"""
select w.program_raw, w.item_raw, p.entry_id as program_id, i.entry_id as item_id,
 case when i.entry_id is null then p.kind else ([{_RANKS}])[greatest(list_position([{_RANKS}], p.kind),
   list_position([{_RANKS}], i.kind))] end as kind
from (select distinct raw as program_raw, item_raw from raw_names) w
join program_ladder p on p.raw = w.program_raw
left join item_ladder i on i.scope = p.entry_id and i.raw = w.item_raw""")
def catalog_resolution(spark, d):
    """Program and item of every distinct wording, similarity included."""
    wordings = sightings(spark, d).select(F.col("raw").alias("program_raw"),
                                          F.col("item_raw"))
    return catalog.resolve(wordings, views.catalog_programs(spark, d),
                           views.catalog_items(spark, d))


@query("E20_unmatched_queue", uses=UNPLACED, sql=f"""
with s as (select *, {sql_norm('raw')} as normalised, cast(engagement_id as varchar) as example
  from raw_names where raw in (from unplaced)),
 x as (select * from (select normalised, example, row_number() over (partition by normalised
  order by first_at, example) as n from (select normalised, example, min(l_shipdate) as first_at
  from s group by all)) where n <= 5)
select s.normalised, s.seen, strftime(first_seen, '%Y-%m-%d') as first_seen,
  strftime(last_seen, '%Y-%m-%d') as last_seen, examples from (
 select normalised, count(*) as seen, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen
 from s group by all) s join (select normalised, string_agg(example, ',' order by n) as examples
 from x group by all) x using (normalised)""")
def unmatched_queue(spark, d):
    rows = unplaced(spark, d, sightings(spark, d)).select(
        "raw", F.col("engagement_id").cast("string").alias("example"),
        F.col("l_shipdate").alias("seen_at"))
    return catalog.unmatched_queue(rows).select(
        "normalised", "seen", F.col("first_seen").cast("date").cast("string"),
        F.col("last_seen").cast("date").cast("string"),
        F.array_join("examples", ",").alias("examples"))


@query("E23_name_clusters", uses="raw_names", sql=f"""
with c as (select raw as name, count(distinct engagement_id) as contracts, {sql_norm('raw')}
  as name_key from raw_names group by all),
 b as (select name_key, first(name order by contracts desc, length(name), name desc) as name,
  max(contracts) as contracts, list(name) as names from c where name_key <> '' group by all)
select name_key, name, {sql_slug('name')} as entry_id, contracts, array_to_string(list_sort(
  list_filter(names, lambda n: n <> name)), '|') as aliases from b""")
def name_clusters(spark, d):
    counts = (sightings(spark, d).groupBy(F.col("raw").alias("name"))
              .agg(F.count_distinct("engagement_id").alias("contracts")))
    return catalog.cluster_names(counts).withColumn("aliases", F.array_join("aliases", "|"))


ov.VIEWS["coverage"] = """select engagement_id, document_id, version, program as program_id,
  list_sort(list(distinct item)) as item_ids, count(*) as priced_items from pricing_terms
  where not superseded group by engagement_id, document_id, version, program"""


def coverage_rows(spark, d):
    live = views.pricing_terms(spark, d).filter("not superseded").select(
        *terms.DOCUMENT, F.lit("pricing").alias("category"), F.col("program").alias("program_id"),
        F.col("item").alias("item_id"), "amount", F.lit(None).cast("string")
        .alias("calculation"))
    return terms.coverage(live)


def coverage_programs(spark, d):
    return views.programs(spark, d).select(
        F.concat("name", F.lit(" Program")).alias("program_id"),
        F.concat("name", F.lit(" Program")).alias("name"),
        (F.length("name") % 7).alias("contract_count"))


def coverage_items(spark, d):
    return views.table(spark, d, "part").select(
        F.concat("p_name", F.lit(" Program")).alias("program_id"),
        F.col("p_brand").alias("item_id")).distinct()


@query("E16_coverage", uses="pricing_terms coverage", sql="""
select engagement_id, document_id, version, program_id, array_to_string(item_ids, ',')
  as item_ids, priced_items from coverage""")
def coverage(spark, d):
    return coverage_rows(spark, d).withColumn("item_ids", F.array_join("item_ids", ","))


@query("D4_program_coverage", uses="pricing_terms coverage programs", sql="""
select p.name || ' Program' as program_id, count(distinct engagement_id) as engagements,
  count(distinct engagement_id) > 0 as availed from programs p left join coverage c
  on p.name || ' Program' = case when c.engagement_id % 2 = 0 then c.program_id
   else c.program_id || ' (other)' end group by all""")
def program_coverage(spark, d):
    # Odd engagements use programs that the catalog does not have.
    used = F.when(F.col("engagement_id") % 2 == 0, F.col("program_id")).otherwise(
        F.concat("program_id", F.lit(" (other)")))
    uses = (coverage_rows(spark, d).groupBy(used.alias("program_id"))
            .agg(F.count_distinct("engagement_id").alias("engagements")))
    return (coverage_programs(spark, d).select("program_id")
            .join(uses, "program_id", "left").na.fill(0, ["engagements"])
            .withColumn("availed", F.col("engagements") > 0))


@query("D5_program_users", uses="pricing_terms coverage engagements", sql="""
select program_id, count(distinct c.engagement_id) as engagements,
  count(distinct customer_id) as customers from coverage c join engagements e
  on e.engagement_id = c.engagement_id group by all""")
def program_users(spark, d):
    owners = views.engagements(spark, d).select("engagement_id", "customer_id")
    pairs = coverage_rows(spark, d).select("program_id", "engagement_id").distinct()
    return (pairs.join(owners, "engagement_id").groupBy("program_id")
            .agg(F.count("*").alias("engagements"),
                 F.count_distinct("customer_id").alias("customers")))


ADOPTION_SQL = """select p.name || ' Program' as name, items as item_count,
  count(distinct engagement_id) as engagement_count, length(p.name) % 7 as contract_count
 from programs p left join coverage c on c.program_id = p.name || ' Program'
 left join (select p_name, count(distinct p_brand) as items from part group by all) i
  on i.p_name = p.name group by all"""


@query("E15_program_adoption", uses="pricing_terms coverage programs", sql=f"""
select name, item_count, engagement_count from ({ADOPTION_SQL})""")
def program_adoption(spark, d):
    return catalog.adoption(coverage_programs(spark, d), coverage_items(spark, d),
                            coverage_rows(spark, d)).select(
        "name", "item_count", "engagement_count")


@query("G5_program_order", uses="pricing_terms coverage programs", sql=f"""
select name, engagement_count, contract_count from ({ADOPTION_SQL})
order by engagement_count desc, contract_count desc, name""")
def program_order(spark, d):
    return (catalog.adoption(coverage_programs(spark, d), coverage_items(spark, d),
                             coverage_rows(spark, d))
            .orderBy(*catalog.adoption_order())
            .select("name", "engagement_count", "contract_count"))


@query("E17_engagement_coverage", uses="pricing_terms coverage programs", sql="""
select engagement_id, count(distinct program_id) as programs_availed, cast(sum(priced_items)
  as bigint) as priced_items, count(distinct document_id) as documents,
  (select count(distinct c2.program_id || '|' || item) from (select engagement_id, program_id,
   unnest(item_ids) as item from coverage) c2 where c2.engagement_id = c.engagement_id)
   as items_availed, (select count(*) from programs) as programs_total
from coverage c group by engagement_id""")
def engagement_coverage(spark, d):
    total = coverage_programs(spark, d).agg(F.count("*").alias("programs_total")).withColumn(
        "k", F.lit(1))
    return (terms.engagement_coverage(coverage_rows(spark, d), coverage_programs(spark, d),
                                      coverage_items(spark, d))
            .withColumn("k", F.lit(1)).join(F.broadcast(total), "k").drop("k"))


@query("E17_program_rows", uses="pricing_terms coverage programs", sql="""
with i as (select p_name || ' Program' as program_id, count(distinct p_brand) as items_total
  from part group by all),
 u as (select engagement_id, program_id, unnest(item_ids) as item from coverage)
select c.engagement_id, c.program_id, any_value(items_total) as items_total,
  cast(sum(priced_items) as bigint) as priced_items,
  count(distinct document_id) as documents, coalesce(any_value(n), 0) as items_availed
from coverage c join i on i.program_id = c.program_id
left join (select engagement_id, program_id, count(distinct item) as n from u group by all) x
  on x.engagement_id = c.engagement_id and x.program_id = c.program_id
group by c.engagement_id, c.program_id""")
def program_rows(spark, d):
    """The availed rows of each engagement's coverage; the others are what is left of the total."""
    return terms.program_rows(coverage_rows(spark, d), coverage_items(spark, d))


def pricing_tables(spark, d):
    """A table per page: every third line heads a program, the others label items."""
    pages = views.document_pages(spark, d).select("document_id", F.explode("pages").alias("p"))
    heading = lambda line: F.concat(F.upper(F.trim(F.regexp_replace(
        line, "[^A-Za-z ]", ""))), F.lit(" PROGRAM"))
    rows = F.transform("p.lines", lambda line, i: F.array(
        F.when(i % 3 == 0, heading(line)).otherwise(line),
        F.lit("$1.00")))
    return pages.select(F.col("document_id").alias("contract"), rows.alias("rows"))


TITLE_SQL = """regexp_replace(replace(replace(replace(replace(array_to_string(list_transform(
  regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)'),
  lambda r: upper(left(r, 1)) || lower(substr(r, 2))), ''), 'Mvr', 'MVR'), 'Dot', 'DOT'),
  'Ev ', 'EV '), 'Sow', 'SOW'), '^\\s+|\\s+$', '', 'g')"""
ov.VIEWS["scanned"] = f"""with c as (select document_id, page_number, line_no, case when
    (line_no - (page_number - 1) * 5 - 1) % 3 = 0 then upper(trim(regexp_replace(line,
     '[^A-Za-z ]', '', 'g'))) || ' PROGRAM' else line end as cell from (
    select *, (line_no - 1) // 5 + 1 as page_number from doc_lines)),
 h as (select *, regexp_replace(trim(regexp_replace(cell, '\\s+', ' ', 'g')), '^ | $', '', 'g')
   as label from c),
 m as (select *, regexp_replace(regexp_extract(label,
   '{fv.HEADING_PATTERN.replace("'", "''")}', 1),
   '(?i)\\s*\\(SECTION[^)]*\\)\\s*$', '') as raw_heading from h),
 t as (select *, {TITLE_SQL.format(x='raw_heading')} as titled from m),
 n as (select *, case when length(regexp_replace(titled, '^(?:[A-Z]\\s+)+([A-Z][a-z])', '\\1'))
   > 8 then regexp_replace(titled, '^(?:[A-Z]\\s+)+([A-Z][a-z])', '\\1') end as heading from t),
 f as (select *, last_value(heading ignore nulls) over (partition by document_id, page_number
   order by line_no rows unbounded preceding) as current from n)
 select document_id as contract, current as program, case when heading is null then label end
   as item from f where heading is not null or (current is not null and length(label) > 4
   and length(label) < 80 and not (regexp_matches(label, '[A-Z]') and label = upper(label)))"""
SCAN = "agreements doc_lines scanned"


@query("I4_table_heading_scan", uses=SCAN, sql="""
select contract, program, item, count(*) as n from scanned group by all""")
def table_heading_scan(spark, d):
    return (catalog.scan_headings(pricing_tables(spark, d))
            .groupBy("contract", "program", "item").agg(F.count("*").alias("n")))


def rules_from(names):
    """Editorial rules by the first letter of a name: some are dropped, some merged."""
    first = F.substring("name", 1, 1)
    return names.select("name").distinct().withColumn("kind", F.when(first == "A", "drop").when(
        first == "B", "merge").when(first == "C", "category")).filter("kind is not null").select(
        "kind", F.col("name").alias("spelling"),
        F.when(F.col("kind") == "merge", F.lit("Combined Beta Program"))
        .when(F.col("kind") == "category", F.lit("Gamma")).alias("target"))


@query("J16_catalog_derivation", uses=SCAN, sql=f"""
with names as (select distinct program as name from scanned),
 s as (select distinct contract, program, {sql_norm('program')} as key from scanned),
 dk as (select distinct {sql_norm('name')} as key from names where left(name, 1) = 'A'),
 mk as (select distinct {sql_norm('name')} as key from names where left(name, 1) = 'B'),
 k as (select *, case when key in (select key from mk) then 'Combined Beta Program'
   else program end as name from s where key not in (select key from dk)),
 c as (select name, count(*) as contracts from k group by all),
 g as (select {sql_norm('name')} as name_key, first(name order by contracts desc, length(name),
  name desc) as name, max(contracts) as contracts from c group by 1)
select name_key, name, {sql_slug('name')} as entry_id, contracts, case when name_key in (
  select {sql_norm('name')} from names where left(name, 1) = 'C') then 'Gamma' end as category
from g where name_key <> ''""")
def catalog_derivation(spark, d):
    pairs = catalog.scan_headings(pricing_tables(spark, d))
    rules = rules_from(pairs.select(F.col("program").alias("name")))
    programs, _items = catalog.derive_catalog(pairs, rules)
    return programs.select("name_key", "name", "entry_id", "contracts", "category")


@query("J16_derived_items", uses=SCAN, sql=f"""
with names as (select distinct program as name from scanned),
 s as (select distinct contract, program, item, {sql_norm('program')} as key from scanned
  where item is not null),
 k as (select *, {sql_norm('''case when key in (select ''' + sql_norm('name')
   + ''' from names where left(name, 1) = 'B') then 'Combined Beta Program' else program end''')}
   as program_key from s where key not in (select {sql_norm('name')} from names
   where left(name, 1) = 'A')),
 c as (select program_key, item as name, count(*) as contracts, {sql_norm('item')} as name_key
  from (select distinct contract, program, item, program_key from k) group by all)
select program_key, name_key, first(name order by contracts desc, length(name), name desc)
  as name, max(contracts) as contracts from c where name_key <> '' group by 1, 2""")
def derived_items(spark, d):
    pairs = catalog.scan_headings(pricing_tables(spark, d))
    rules = rules_from(pairs.select(F.col("program").alias("name")))
    return catalog.derive_catalog(pairs, rules)[1].select(
        "program_key", "name_key", "name", "contracts")


def curation_rules(spark, d):
    """Rules over the part-name catalog: names starting with g drop, with b merge into a target."""
    first = F.substring("name", 1, 1)
    target = views.programs(spark, d).agg(F.max("name").alias("target"))
    rules = views.programs(spark, d).withColumn("kind", F.when(first == "g", "drop").when(
        first == "b", "merge").when(first == "c", "category")).filter("kind is not null")
    return (rules.withColumn("k", F.lit(1)).join(
        F.broadcast(target.withColumn("k", F.lit(1))), "k")
        .select("kind", F.col("name").alias("spelling"),
                F.when(F.col("kind") == "merge", F.col("target"))
                .when(F.col("kind") == "category", "Cool").alias("target")))


@query("J17_recuration", uses="programs program_keys", sql="""
with t as (select max(name) as target from programs),
 p as (select *, length(name) % 7 as contracts from program_keys, t),
 m as (select sum(contracts) as moved, list(name) as names from p where left(name, 1) = 'b'
  and name <> target)
select program_id, name, contracts + case when name = target then coalesce(moved, 0) else 0 end
  as contracts, case when left(name, 1) = 'c' then 'Cool' else 'none' end as category,
  case when name = target then array_to_string(list_sort(names), '|') else '' end as aliases
from p, m where left(name, 1) <> 'g' and (left(name, 1) <> 'b' or name = target)""")
def recuration(spark, d):
    programs = views.catalog_programs(spark, d).select(
        "program_id", "name", F.array().cast("array<string>").alias("aliases"),
        F.lit("none").alias("category"), (F.length("name") % 7).cast("bigint")
        .alias("contracts"))
    items = views.catalog_items(spark, d)
    kept, _ = catalog.recurate(programs, items, curation_rules(spark, d))
    return kept.withColumn("aliases", F.array_join("aliases", "|"))


# --- materialise, merge, fold ----------------------------------------------------------------
@query("J1_term_materialisation", uses="records programs program_keys", sql=f"""
with m as (select *, {ov.SQL_RECORD_ID} as record_id, {CATEGORY_SQL} as term_category,
  case when info_type = 'pricing_item' then {sql_slug("replace(program, ' Program', '')")} end
   as program_id, case when info_type = 'pricing_item' and item is not null
   then {sql_slug('item')} end as item_id,
  case when info_type = 'pricing_item' then 'normalised' end as match from records),
 f as (select *, row_number() over (partition by document_id, version, record_id
  order by ordinal) as rn from m)
select document_id, version, record_id, term_category as category, program_id, item_id,
  match as catalog_match, (confidence <= 0.8 or quote is null or (info_type = 'pricing_item'
   and item is not null and not included and amount is null and calculation is null))
   as needs_review,
  case when info_type = 'pricing_item' then split_part({ov.frequency_case(
   "concat_ws(' ', nullif(frequency, ''), nullif(calculation, ''))")}, '|', 1) end as unit_basis
from f where rn = 1""")
def term_materialisation(spark, d):
    return terms.materialise(views.records(spark, d), views.catalog_programs(spark, d),
                             views.catalog_items(spark, d)).select(
        "document_id", "version", "record_id", "category", "program_id", "item_id",
        "catalog_match", "needs_review", "unit_basis")


MERGE_SQL = """with o as (select engagement_id, document_id, version, term_key, cast(amount as
   varchar) as body, approved, superseded from pricing_terms),
 n as (select engagement_id, document_id, version, case when l_partkey % 10 < 2
   then term_key || '-new' else term_key end as term_key, cast(case when l_partkey % 10 = 2
   then amount + 1 else amount end as varchar) as body, confidence <= 0.8 as needs_review
   from pricing_terms),
 j as (select coalesce(o.term_key, n.term_key) as record_id, o.term_key is not null as was,
   n.term_key is not null as found, o.approved, o.superseded, o.body = n.body as same,
   n.needs_review from o full join n on o.term_key = n.term_key),
 a as (select *, case when not was then 'write' when not found then case when superseded
   then 'keep' else 'supersede' end when same then case when superseded then 'restore'
   else 'keep' end else 'rewrite' end as action from j)"""


@query("J3_reextraction_merge", uses="pricing_terms", sql=f"""
{MERGE_SQL} select record_id, action, case when action = 'rewrite' then false
  else coalesce(approved, false) end as approved, case when action = 'rewrite' then true
  when action = 'write' then needs_review end as needs_review,
  case when action = 'rewrite' then approved else false end as changed_since_approval from a""")
def reextraction_merge(spark, d):
    existing, fresh = readings_before_after(spark, d)
    return terms.merge_terms(existing, fresh).select(
        "record_id", "action", "approved", "needs_review", "changed_since_approval")


@query("D7_existing_fresh_join", uses="pricing_terms", sql=f"""
{MERGE_SQL} select action, was, found, count(*) as terms from a group by all""")
def existing_fresh_join(spark, d):
    existing, fresh = readings_before_after(spark, d)
    out = terms.merge_terms(existing, fresh)
    was = F.col("action") != "write"
    found = ~((F.col("action") == "supersede") | F.col("old_only"))
    seen = fresh.select("record_id", F.lit(False).alias("old_only"))
    return (out.join(seen, "record_id", "left")
            .withColumn("old_only", F.coalesce("old_only", F.lit(True)))
            .groupBy("action", was.alias("was"), found.alias("found"))
            .agg(F.count("*").alias("terms")))


def readings_before_after(spark, d):
    rows = views.pricing_terms(spark, d).withColumn("record_id", F.col("term_key"))
    body = F.col("amount").cast("string")
    existing = rows.select(
        *terms.DOCUMENT, "record_id", body.alias("body_hash"), "approved",
        F.lit(False).alias("corrected"), "superseded", F.lit("kept").alias("notes"),
        F.lit(AS_OF).alias("created_at"))
    moved = F.when(F.col("l_partkey") % 10 == 2, (F.col("amount") + 1).cast("string")
                   ).otherwise(body)
    # A fifth of the terms is read again as other terms.
    renamed = F.when(F.col("l_partkey") % 10 < 2, F.concat("record_id", F.lit("-new"))).otherwise(
        F.col("record_id"))
    fresh = rows.select(
        *terms.DOCUMENT, renamed.alias("record_id"), moved.alias("body_hash"),
        (F.col("confidence") <= 0.8).alias("needs_review"), F.lit("new").alias("notes"),
        F.lit("2000-07-01").alias("created_at"))
    return existing, fresh


FOLDED = [c for c in terms.BODY if c != "info_type"]
# What a window does not see of a term: the field, and when it is missing.
UNSEEN = {"item": "w = 3 and info_type = 'pricing_item' and partkey % 9 = 0",
          "amount": "w = 3 and suppkey % 7 = 0", "definition": "w = 1", "platform": "w = 2",
          "description": "w = 3", "contract_sub_section": "w <> 2", "frequency": "w = 2 and amount is null",
          "responsible_party": "w = 1", "company": "w = 3", "notes": "w <> 1"}
ov.VIEWS["readings"] = """with r as (select records.* exclude (calculation, quote, ordinal), w,
  cast(split_part(ordinal, '-', 3) as int) as partkey,
  cast(split_part(ordinal, '-', 4) as int) as suppkey,
  case when w = 2 and info_type = 'pricing_item' then 'per schedule' end as calculation,
  case when info_type = 'pricing_item' then case w when 1 then ['1-100:' || coalesce(cast(
   amount as varchar), '')] when 2 then ['101-:' || rate_pct] else [] end else [] end as bands,
  case when quote is null then [] else [quote, quote || ' ' || w] end as quotes,
  concat(ordinal, '-', w) as ordinal
  from records, (select unnest([1, 2, 3]) as w))
 select * replace (""" + ", ".join(
    f"case when not ({when}) then {c} end as {c}" for c, when in UNSEEN.items()) + ") from r"
ov.VIEWS["identified"] = f"""select *, {ov.SQL_RECORD_ID} as record_id, {ov.SQL_LINE_KEY} as line_key,
  {" + ".join(f"case when coalesce(cast({c} as varchar), '') <> '' then 1 else 0 end"
              for c in FOLDED)} + case when len(bands) > 0 then 1 else 0 end
  + case when len(quotes) > 0 then 1 else 0 end as filled from readings"""
ov.VIEWS["folded"] = """select engagement_id, document_id, version, record_id, """ + ", ".join(
    f"first({c} order by filled desc, ordinal) filter (where coalesce(cast({c} as varchar), '') "
    f"<> '') as {c}" for c in FOLDED) + """, min(info_type) as info_type,
  count(*) as readings, min(line_key) as line_key,
  len(list_distinct(flatten(list(bands)))) as bands,
  len(list_distinct(flatten(list(quotes)))) as quotes,
  len(list_distinct(flatten(list(bands)))) > first(len(bands) order by filled desc, ordinal)
   or len(list_distinct(flatten(list(quotes)))) > first(len(quotes) order by filled desc, ordinal)
   as gained from identified group by engagement_id, document_id, version, record_id"""
ov.VIEWS["survivors"] = """select f.*, f.info_type = 'pricing_item' and coalesce(f.item, '') = ''
   and p.program is not null as bare from folded f left join (select distinct document_id, version,
   program from folded where info_type = 'pricing_item' and coalesce(item, '') <> '') p
   on p.document_id = f.document_id and p.version = f.version and p.program = f.program"""
FOLD = "records readings identified folded survivors"


LISTS = ["tier_bands", "citations"]
#: Columns of folded readings that bare programs and conflicts are found by.
CONFLICT = [*terms.DOCUMENT, "info_type", *fv.IDENTITY_FIELDS["pricing_item"], "amount", "included"]


def duplicate_readings(spark, d):
    """Every record of all nine types read in three windows that see different parts of it."""
    key = F.split("ordinal", "-")
    rows = (views.records(spark, d)
            .withColumn("partkey", key[2].cast("int")).withColumn("suppkey", key[3].cast("int"))
            .withColumn("w", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))))
    w, priced = F.col("w"), F.col("info_type") == "pricing_item"
    none = F.array().cast("array<struct<min_units:int,max_units:int,amount:decimal(18,2)>>")
    quote = F.col("citations")[0].quote
    read = rows.withColumns({
        "calculation": F.when((w == 2) & priced, "per schedule"),
        "tier_bands": F.when((w == 1) & priced, F.array(
            band(F.lit(1), F.lit(100), F.col("amount")))).when((w == 2) & priced, F.array(
                band(F.lit(101), F.lit(None), F.col("rate_pct")))).otherwise(none),
        "citations": F.when(F.col("citations").isNull(), F.array().cast(
            "array<struct<quote:string>>")).otherwise(F.array(
                F.struct(quote.alias("quote")),
                F.struct(F.concat_ws(" ", quote, w.cast("string")).alias("quote")))),
        "ordinal": F.concat_ws("-", "ordinal", w.cast("string"))})
    return read.withColumns({c: F.when(~F.expr(when), F.col(c)) for c, when in UNSEEN.items()})


@query("J5_duplicate_reading_fold", uses=FOLD, sql=f"""
select document_id, version, record_id, info_type, readings, bands, quotes,
  cast(amount as double) as amount, cast(rate_pct as double) as rate_pct,
  {", ".join(c for c in FOLDED if c not in ("amount", "rate_pct"))} from survivors where not bare""")
def duplicate_reading_fold(spark, d):
    folded = terms.fold_readings(duplicate_readings(spark, d), LISTS).select(
        *terms.DOCUMENT, "record_id", "info_type", "readings", F.size("tier_bands").alias("bands"),
        F.size("citations").alias("quotes"), *FOLDED)
    kept, _ = terms.drop_bare(folded)
    return kept.select("document_id", "version", "record_id", "info_type", "readings", "bands", "quotes",
                       *[F.col(c).cast("double") if c in ("amount", "rate_pct") else F.col(c)
                         for c in FOLDED])


@query("J5_fold_report", uses=FOLD, sql="""
with c as (select document_id, version, line_key from survivors where not bare
  and info_type = 'pricing_item' group by all having count(distinct coalesce(cast(amount as varchar), 'None')) > 1)
select s.document_id, s.version, cast(sum(readings - 1) as bigint) as collapsed,
  count(*) filter (where gained) as unioned, count(*) filter (where not bare) as kept,
  count(*) filter (where bare) as bare_dropped, coalesce(max(n), 0) as conflicts
from survivors s left join (select document_id, version, count(*) as n from c group by all) c
 on c.document_id = s.document_id and c.version = s.version group by all""")
def fold_report(spark, d):
    records = duplicate_readings(spark, d)
    folded = cut_lineage(terms.fold_readings(records, LISTS).select(*CONFLICT, "readings", "gained"), "folded")
    kept, dropped = terms.drop_bare(folded, written=True)
    conflicts = terms.amount_conflicts(kept)
    return terms.fold_report(records, folded, kept, dropped, conflicts).drop("engagement_id")


@query("E27_amount_conflicts", uses=FOLD, sql="""
select document_id, version, line_key, array_to_string(list_sort(list(distinct
  coalesce(cast(amount as varchar), 'None'))), ', ') as amounts from survivors where not bare
  and info_type = 'pricing_item' group by all having count(distinct coalesce(cast(amount as varchar), 'None')) > 1""")
def amount_conflicts(spark, d):
    kept, _ = terms.drop_bare(terms.fold_readings(duplicate_readings(spark, d), LISTS).select(*CONFLICT))
    return terms.amount_conflicts(kept).select(
        "document_id", "version", "line_key", F.array_join("amounts", ", ").alias("amounts"))


@query("H7_united_lists", uses=FOLD, sql="""
select document_id, version, record_id, array_to_string(list_sort(list_distinct(flatten(
  list(bands)))), '|') as bands from identified group by all""")
def united_lists(spark, d):
    folded = terms.fold_readings(duplicate_readings(spark, d), LISTS)
    text = F.array_sort(F.transform("tier_bands", lambda t: F.concat(
        t.min_units.cast("string"), F.lit("-"), F.coalesce(t.max_units.cast("string"), F.lit("")),
        F.lit(":"), F.coalesce(t.amount.cast("string"), F.lit("")))))
    return folded.select("document_id", "version", "record_id",
                         F.coalesce(F.array_join(text, "|"), F.lit("")).alias("bands"))


@query("I3_exploded_bands", uses=FOLD, sql="""
select ordinal, cast(pos as int) as position, band from (select ordinal, unnest(bands) as band,
  generate_subscripts(bands, 1) - 1 as pos from readings)
union all select ordinal, null, null from readings where len(bands) = 0""")
def exploded_bands(spark, d):
    text = F.concat(F.col("b.min_units").cast("string"), F.lit("-"),
                    F.coalesce(F.col("b.max_units").cast("string"), F.lit("")), F.lit(":"),
                    F.coalesce(F.col("b.amount").cast("string"), F.lit("")))
    return (duplicate_readings(spark, d)
            .select("ordinal", F.posexplode_outer("tier_bands").alias("position", "b"))
            .select("ordinal", "position", F.when(F.col("b").isNotNull(), text).alias("band")))


# --- change sets -----------------------------------------------------------------------------
@query("J26_bulk_approval", uses="records stored_terms", sql="""
select ordinal, not superseded and not approved and (term_category = 'pricing' and
   document_id % 2 = 0 or document_id % 5 = 0) as newly_approved,
  approved or (not superseded and (term_category = 'pricing' and document_id % 2 = 0
   or document_id % 5 = 0)) as approved,
  needs_review and not (not superseded and not approved and (term_category = 'pricing' and
   document_id % 2 = 0 or document_id % 5 = 0)) as needs_review from stored_terms""")
def bulk_approval(spark, d):
    """Even documents approve pricing, every fifth approves everything."""
    rows = stored_terms(spark, d)
    docs = rows.select("document_id", "version").distinct()
    asks = (docs.filter("document_id % 2 = 0").withColumn("category", F.lit("pricing"))
            .unionByName(docs.filter("document_id % 5 = 0")
                         .withColumn("category", F.lit(None).cast("string"))))
    return changes.approve_terms(rows, asks).select("ordinal", "newly_approved", "approved",
                                                    "needs_review")


@query("J26_corrections", uses="pricing_terms", sql="""
select term_key, l_partkey % 8 = 0 as corrected, case when l_partkey % 8 = 0 then
  'Corrected Program' else program end as program, cast(case when l_partkey % 8 = 0 and
  l_suppkey % 2 = 0 then amount * 2 else amount end as double) as amount from pricing_terms""")
def corrections(spark, d):
    rows = views.pricing_terms(spark, d).select("term_key", "program", "amount", "l_partkey",
                                                "l_suppkey")
    patch = rows.filter("l_partkey % 8 = 0").select(
        "term_key", F.lit("Corrected Program").alias("program"),
        F.when(F.col("l_suppkey") % 2 == 0, (F.col("amount") * 2).cast("decimal(18,2)"))
        .alias("amount"))
    return changes.correct_terms(rows, patch, "term_key", ["program", "amount"]).select(
        "term_key", "corrected", "program", F.col("amount").cast("double"))


def queue_rows(spark, d):
    return (unplaced(spark, d, sightings(spark, d).select("raw").distinct()).withColumn("normalised", normalise_name(F.col("raw"))))


@query("J27_catalog_aliases", uses="raw_names programs program_keys", sql=f"""
select program_id, array_to_string(list_sort(list_distinct(list_concat([name || ' Plan'],
  [name || ' Extra', name || ' Bonus']))), '|') as aliases from program_keys""")
def catalog_aliases(spark, d):
    programs = views.catalog_programs(spark, d)
    edits = programs.select("program_id", F.explode(F.array(
        F.concat("name", F.lit(" Extra ")), F.concat(F.lit(" "), "name", F.lit(" Bonus")),
        F.col("name"), F.lit("  "))).alias("alias"))
    return changes.add_aliases(programs, edits).select(
        "program_id", F.array_join("aliases", "|").alias("aliases"))


@query("J27_queue_after_edits", uses=UNPLACED, sql=f"""
select distinct {sql_norm('raw')} as normalised from unplaced where {sql_norm('raw')} not in (
 select {sql_norm('raw')} from unplaced where raw like '% TIN' or raw like '%BRASS' or raw like 'cold%')""")
def queue_after_edits(spark, d):
    queue = queue_rows(spark, d)
    edits = queue.filter("raw like '% TIN' or raw like '%BRASS' or raw like 'cold%'").select(
        F.col("raw").alias("alias"))
    return changes.close_unmatched(queue, edits).select("normalised").distinct()


@query("J27_promotions", uses=UNPLACED, sql=f"""
with q as (select distinct raw, {sql_norm('raw')} as normalised from unplaced),
 p as (select raw, case when length(raw) % 2 = 0 then 'Promoted ' || raw else raw end as name
  from q) select {sql_slug('name')} as program_id, name,
  case when raw <> name then raw else '' end as aliases from p""")
def promotions(spark, d):
    queue = queue_rows(spark, d)
    asks = queue.select("normalised", F.when(
        F.length("raw") % 2 == 0, F.concat(F.lit("Promoted "), "raw")).alias("new_name"))
    return changes.promote(queue, asks.distinct()).select(
        "program_id", "name", F.array_join("aliases", "|").alias("aliases"))
