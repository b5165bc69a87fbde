"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallypact import views
from tallypact.functions.text import decimal_text
from tallypact.plans import billing, changes
from tallypact.session import durable_dir
from tallypact.sources import payloads, tables
from tallypact.sources.batch_table import BatchTable
from tallypact.streaming import jobs
from tallypact.workload import oracle_views as ov
from tallypact.workload.agreements import DOCS
from tallypact.workload.contract_terms import CATEGORY_SQL, coverage_rows, stored_terms
from tallypact.workload.money import SQL_LINES, billed
from tallypact.workload.name_sql import UNPLACED
from tallypact.workload.registry import query
from tallypact.workload.scalars import reuploads, sql_money, sql_norm, sql_slug


BUCKETS = 8


# --- sources and sinks -----------------------------------------------------------------------
@query("A1_load_entity", uses="customers", sql="select * from customers")
def load_entity(spark, d):
    """Customers and engagements share a store; only the customers' folder is read."""
    path = durable_dir(spark, "entities")
    customers = views.customers(spark, d)
    stored = customers.withColumn("PK", F.concat(F.lit("CUST#"), F.col("customer_id")
                                                 .cast("string"))).withColumn("SK", F.lit("META"))
    tables.write_entities({"CUSTOMER": stored, "ENGAGEMENT": views.engagements(spark, d).select(
        "engagement_id", "customer_id", "status")}, path)
    schema = stored.schema.add("type", "string")
    return tables.load_entity(spark, path, "CUSTOMER", schema)


@query("A2_keyed_reads", uses="records vehicles", sql=f"""
select 'terms' as source, concat(document_id, '/', version) as key, count(*) as n from records
where {CATEGORY_SQL} = 'pricing' group by 2
union all select 'vehicles', concat(ownership, '/', status), count(*) from vehicles
where engagement_id is not null group by 2""")
def keyed_reads(spark, d):
    """Terms of one category from a table partitioned by category; vehicles by ownership."""
    path = durable_dir(spark, "terms-by-category")
    stored_terms(spark, d).select("document_id", "version", "category", "ordinal").write.partitionBy(
        "category").parquet(path)
    terms_ = (spark.read.parquet(path).filter("category = 'pricing'")
              .groupBy(F.concat_ws("/", F.col("document_id").cast("string"),
                                   F.col("version").cast("string")).alias("key"))
              .agg(F.count("*").alias("n")).withColumn("source", F.lit("terms")))
    units = (views.vehicles(spark, d).filter("engagement_id is not null")
             .groupBy(F.concat_ws("/", "ownership", "status").alias("key"))
             .agg(F.count("*").alias("n")).withColumn("source", F.lit("vehicles")))
    return terms_.unionByName(units)


def keyed_table(spark, rows, name, key):
    """``rows`` as a table that is read by ``key``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    made = BatchTable(spark, durable_dir(spark, name), schema, [key], BUCKETS)
    made.merge(0, rows, lambda old, new: new)
    return made


@query("A2_reads_by_key", uses="customers engagements memberships provider_directory vehicles "
       "pricing_terms coverage", sql="""
select 'coverage' as source, program_id as key, count(*) as n from coverage
 where program_id in (select p_name || ' Program' from part) group by 2
union all select 'engagements', cast(customer_id as varchar), count(*) from engagements
 where customer_id in (select customer_id from customers where status = 'INACTIVE') group by 2
union all select 'memberships', cast(user_id as varchar), count(*) from memberships
 where user_id in (select user_id from provider_directory) group by 2
union all select 'vehicles', cast(engagement_id as varchar), count(*) from vehicles
 where engagement_id in (select engagement_id from engagements where status = 'ACTIVE') group by 2""")
def reads_by_key(spark, d):
    """Coverage by program, engagements by customer, memberships by user and vehicles by engagement."""
    deals = views.engagements(spark, d).select("engagement_id", "customer_id", "status")
    units = views.vehicles(spark, d).select("vehicle_id", "engagement_id").filter("engagement_id is not null")
    reads = [
        ("coverage", coverage_rows(spark, d).select("document_id", "version", "program_id"), "program_id",
         views.programs(spark, d).select(F.concat("name", F.lit(" Program")).alias("program_id"))),
        ("engagements", deals, "customer_id", views.customers(spark, d).filter("status = 'INACTIVE'")),
        ("memberships", views.memberships(spark, d).select("engagement_id", "user_id", "role"), "user_id",
         views.provider_directory(spark, d)),
        ("vehicles", units, "engagement_id", deals.filter("status = 'ACTIVE'"))]
    out = None
    for name, rows, key, asked in reads:
        found = keyed_table(spark, rows, name, key).of(asked.select(key))
        part = found.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(
            F.lit(name).alias("source"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def raw_payloads(spark, d):
    """A JSON text per order: whole, cut off, wrapped in a string, junk, or one object."""
    kind = F.when(F.col("l_partkey") % 25 == 0, "mystery").otherwise("pricing_item")
    program = F.when(F.col("l_partkey") % 25 != 1, F.col("program"))
    rows = views.pricing_terms(spark, d).select(
        "document_id", F.struct(
            F.col("term_key"), kind.alias("info_type"), program.alias("program"), "item",
            F.col("amount").cast("double").alias("amount"),
            F.col("confidence").cast("double").alias("confidence"),
            F.array(F.struct(F.concat(F.lit('say "'), "item", F.lit('" {now}'))
                             .alias("quote"))).alias("citations")).alias("r"))
    # The text of one document is one payload, as an extraction returns it.
    grouped = rows.groupBy("document_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    whole = F.to_json("rs")
    last = F.col("document_id") % 10
    text = (F.when(last == 0, F.substr(whole, F.lit(1), F.length(whole) - 10))
            .when(last == 1, F.to_json(F.array(whole)))
            .when(last == 2, "no terms found").when(last == 3, F.to_json(F.get("rs", F.lit(0))))
            .otherwise(whole))
    text = F.when(last == 1, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return grouped.select("document_id", text.alias("payload"))


ov.VIEWS["payload_rows"] = """select * from (select *, row_number() over (partition by document_id
   order by term_key) as rn, count(*) over (partition by document_id) as total
   from pricing_terms) where case document_id % 10 when 0 then rn < total when 2 then false
   when 3 then rn = 1 else true end"""


@query("A3_ingest_records", uses="pricing_terms payload_rows", sql="""
select document_id, term_key, program, cast(amount as double) as amount,
  document_id % 10 = 0 as salvaged from payload_rows where l_partkey % 25 > 1""")
def ingest_records(spark, d):
    good, _ = payloads.ingest_records(raw_payloads(spark, d))
    return good.select(
        "document_id", F.try_variant_get("record", "$.term_key", "string").alias("term_key"),
        F.try_variant_get("record", "$.program", "string").alias("program"),
        F.try_variant_get("record", "$.amount", "double").alias("amount"), "salvaged")


@query("A3_refused_records", uses="pricing_terms payload_rows", sql="""
select document_id, case when l_partkey % 25 = 0 then 'unknown info_type'
  else 'program is required' end as reason, count(*) as n from payload_rows
where l_partkey % 25 <= 1 group by all
union all select document_id, 'no records in payload', 1 from (select document_id, count(*) as n
  from pricing_terms group by all) where document_id % 10 = 2 or (document_id % 10 = 0
  and n = 1)""")
def refused_records(spark, d):
    _, refused = payloads.ingest_records(raw_payloads(spark, d))
    return refused.groupBy("document_id", "reason").agg(F.count("*").alias("n"))


@query("A4_salvaged_records", uses="pricing_terms payload_rows", sql="""
select document_id, count(*) as records, min(term_key) as first_term from payload_rows
where document_id % 10 = 0 group by all""")
def salvaged_records(spark, d):
    rows = payloads.record_rows(raw_payloads(spark, d)).filter(
        "salvaged and record is not null")
    return rows.groupBy("document_id").agg(
        F.count("*").alias("records"),
        F.min(F.try_variant_get("record", "$.term_key", "string")).alias("first_term"))


@query("A5_load_catalog", uses="programs", sql=f"""
select {sql_slug('p_name')} as program_id, {sql_slug('p_brand')} as item_id, p_brand as name
from (select distinct p_name, p_brand from part)""")
def load_catalog(spark, d):
    path = durable_dir(spark, "catalog-json")
    items = views.catalog_items(spark, d).groupBy("program_id").agg(
        F.collect_list(F.struct(F.lit(None).cast("string").alias("item_id"), "name",
                                "aliases")).alias("items"))
    views.catalog_programs(spark, d).join(items, "program_id").select(
        "name", "aliases", "items").write.json(path)
    return tables.load_catalog(spark, path)[1].select("program_id", "item_id", "name")


@query("A6_import_workbook", uses="records", sql="""
select info_type, coalesce(program, category, report_name, term, tool_name, task, company, topic,
  item) as head, included, cast(amount as double) as amount, count(*) as n from (
  select info_type, program, category, report_name, term, tool_name, task, company, topic,
   case when info_type = 'uncategorised' then coalesce(case when ordinal like '%1' then null
    else item end, 'TBD section') end as item,
   case when info_type = 'pricing_item' then notes is not null end as included, amount
  from records) group by all""")
def import_workbook(spark, d):
    """Each record type written as its sheet's CSV with the workbook's headings, then imported."""
    path = durable_dir(spark, "workbook")
    rows = views.records(spark, d).withColumn("notes", F.when(
        F.col("notes").isNotNull(), "Included")).withColumn("item", F.when(
            ~((F.col("info_type") == "uncategorised") & F.col("ordinal").endswith("1")),
            F.col("item"))).withColumn("contract_section", F.lit("TBD section"))
    sheets = {}
    for i, (sheet, (info_type, mapping)) in enumerate(tables.WORKBOOK_SHEETS.items()):
        have = {h: f for h, f in mapping.items() if f in rows.columns}
        shown = rows.filter(F.col("info_type") == info_type).select(
            *[F.col(f).cast("string").alias(h) for h, f in have.items()],
            F.col("notes").alias("Notes"), F.col("contract_section").alias("Contract Section"))
        shown.write.option("header", True).csv(f"{path}/{i}")
        sheets[sheet] = spark.read.option("header", True).schema(shown.schema).csv(f"{path}/{i}")
    out = tables.import_workbook(sheets)
    head = F.coalesce("program", "category", "report_name", "term", "tool_name", "task",
                      "company", "topic", "item")
    return out.groupBy("info_type", head.alias("head"), "included",
                       F.col("amount").cast("double").alias("amount")).agg(
        F.count("*").alias("n"))


@query("A7_write_billing_configs", uses="pricing_terms priced_terms", sql=f"""
select engagement_id, count(*) as items, cast(sum(billed) as double) as amount
from ({SQL_LINES}) where billed is not null group by all""")
def write_billing_configs(spark, d):
    path = durable_dir(spark, "billing-configs")
    header, lines = billing.config_documents(billed(spark, d))
    tables.write_billing_configs(header, lines, path)

    def stored(name, df):
        return spark.read.schema(df.schema.add("bucket", IntegerType())).json(f"{path}/{name}")

    counted = stored("lines", lines).groupBy("engagement_id").agg(
        F.count("*").alias("n"), F.sum("fee.amount").cast("double").alias("billed"))
    # Headers say what the lines add up to.
    return (stored("headers", header).join(counted, "engagement_id")
            .filter("items = n and abs(amount - billed) < 0.005")
            .select("engagement_id", "items", F.col("amount").cast("double")))


@query("A8_write_extraction", uses="records stored_terms calls", sql="""
select 'records/' || term_category as source, count(*) as n from stored_terms group by 1
union all select 'runs', count(distinct run_id) from calls""")
def write_extraction(spark, d):
    from tallypact.plans.quality import run_telemetry
    from tallypact.workload.runs import runs

    path = durable_dir(spark, "extractions")
    tables.write_extraction(stored_terms(spark, d).drop("tier_bands", "citations"),
                            run_telemetry(runs(spark, d)), path)
    by_category = spark.read.parquet(f"{path}/records").groupBy(
        F.concat(F.lit("records/"), "category").alias("source")).agg(F.count("*").alias("n"))
    return by_category.unionByName(spark.read.parquet(f"{path}/runs").agg(
        F.count("*").alias("n")).select(F.lit("runs").alias("source"), "n"))


UPSERT_SQL = """select engagement_id, case when engagement_id % 4 = 0 then 'SECOND'
  when engagement_id % 2 = 0 then 'FIRST' else status end as status from engagements
union all select -engagement_id, 'NEW' from engagements where engagement_id % 1000 = 1"""


@query("A9_upsert", uses="engagements", sql=UPSERT_SQL)
def upsert(spark, d):
    base, first, second, new = status_changes(spark, d)
    return changes.upsert(base, first.unionByName(second).unionByName(new), ["engagement_id"],
                          F.col("at").cast("timestamp"))


def status_changes(spark, d):
    base = views.engagements(spark, d).select("engagement_id", "status")
    first = base.filter("engagement_id % 2 = 0").select(
        "engagement_id", F.lit("FIRST").alias("status"), F.lit("2000-01-01").alias("at"))
    second = base.filter("engagement_id % 4 = 0").select(
        "engagement_id", F.lit("SECOND").alias("status"), F.lit("2000-01-02").alias("at"))
    new = base.filter("engagement_id % 1000 = 1").select(
        (-F.col("engagement_id")).alias("engagement_id"), F.lit("NEW").alias("status"),
        F.lit("2000-01-03").alias("at"))
    return base, first, second, new


@query("A9_written_upsert", uses="engagements", sql=UPSERT_SQL)
def written_upsert(spark, d):
    """Two batches written into a table keyed by engagement; the second comes twice, as after a failure."""
    base, first, second, new = status_changes(spark, d)
    stored = keyed_table(spark, base, "statuses", "engagement_id")
    later = second.unionByName(new)
    for number, batch in ((1, first), (2, later), (2, later)):
        changes.upsert_into(stored, number, batch, F.col("at").cast("timestamp"))
    return stored.rows()


@query("A11_money_boundary", uses="", sql=f"""
select o_orderkey as engagement_id, cast(cast(o_totalprice as decimal(18,2)) as double) as stored,
  {sql_money('o_totalprice')} as shown from orders""")
def money_boundary(spark, d):
    stored = tables.money(F.col("o_totalprice"))
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("engagement_id"), stored.cast("double").alias("stored"),
        decimal_text(stored).alias("shown"))


# --- streams ---------------------------------------------------------------------------------
ARRIVALS = 3


def arriving(spark, rows, purpose, part, run):
    """``rows`` arrive in three parts, the files of each in the folder before ``run`` is called on a stream over it.

    ``part`` numbers a row's part from 0. Every call of ``run`` goes on with the same state.
    """
    folder, state = durable_dir(spark, f"{purpose}-in"), durable_dir(spark, purpose)
    out = None
    for n in range(ARRIVALS):
        rows.filter(part == n).write.mode("append").parquet(folder)
        out = run(spark.readStream.schema(rows.schema).parquet(folder), state)
    return out


@query("K1_document_arrival", uses=f"{DOCS} ranked sanity", sql="""
select document_id, engagement_id, doc_type, ranked_standing,
 case when document_id % 3 = 0 and reasons <> '' then 'refused' else 'parsed' end as version_status,
 case when document_id % 3 = 0 then reasons else '' end as reasons from ranked join sanity using (document_id)""")
def document_arrival(spark, d):
    """Later parts replace earlier winners; every third document is a re-upload and passes the gate or not."""
    rows = reuploads(spark, d).withColumnRenamed("client", "client_name").withColumn(
        "reupload", F.col("document_id") % 3 == 0)
    out = arriving(spark, rows, "documents", F.pmod(F.col("document_id") * 7, F.lit(ARRIVALS)),
                   lambda stream, state: jobs.document_arrival(stream, state, BUCKETS))
    return out.select("document_id", "engagement_id", "doc_type", "ranked_standing", "version_status", "reasons")


@query("K2_lifecycle_state", uses="transitions", sql=ov.LATE_REPLAY_SQL)
def lifecycle_state(spark, d):
    """Events arrive in three parts that overlap in time; a late event applies when it arrives."""
    rows = views.audit_events(spark, d)
    return arriving(spark, rows, "events", F.pmod(F.col("event_id"), F.lit(ARRIVALS)),
                    lambda stream, state: jobs.lifecycle_state(stream, state, BUCKETS))


READING_SQL = f"""
with lined as (select *, split_part(ordinal, '-', 2)::int as line, split_part(ordinal, '-', 3)::bigint as part,
   split_part(ordinal, '-', 4)::bigint as supp from records),
 read as (select l.* replace (case when info_type = 'pricing_item' and supp % 5 = 4 then 'unlisted zone ' || supp
    else program end as program, case when g = 2 and supp % 3 = 0 then 'moved' else notes end as notes), g
  from lined l, range(3) r(g) where (line + part + g) % 4 <> 0),
 keyed as (select *, {ov.SQL_RECORD_ID} as record_id, {CATEGORY_SQL} as term_category from read),
 fresh as (select *, md5(concat_ws('|', info_type, coalesce(program, '~'), coalesce(item, '~'), coalesce(frequency, '~'),
    coalesce(amount::varchar, '~'), coalesce(calculation, '~'), coalesce(included::varchar, '~'), coalesce(rate_pct::varchar, '~'),
    coalesce(category, '~'), coalesce(contract_sub_section, '~'), coalesce(report_name, '~'), coalesce(term, '~'),
    coalesce(definition, '~'), coalesce(tool_name, '~'), coalesce(platform, '~'), coalesce(topic, '~'), coalesce(task, '~'),
    coalesce(responsible_party, '~'), coalesce(company, '~'), coalesce(name, '~'), coalesce(description, '~'),
    coalesce(notes, '~'))) as body,
   (confidence <= 0.8 or quote is null or (info_type = 'pricing_item' and (program like 'unlisted%' or (item is not null
    and not included and amount is null and calculation is null)))) as review
  from keyed qualify row_number() over (partition by document_id, version, record_id, g order by ordinal) = 1),
 last_read as (select document_id, version, max(g) as g from fresh group by all)"""


def readings(spark, d):
    """Every document version read up to three times: lines come and go, and the last reading changes notes."""
    part = F.split("ordinal", "-")
    line, p, supp = part[1].cast("int"), part[2].cast("long"), part[3].cast("long")
    rows = views.records(spark, d).withColumn("g", F.explode(F.array(*[F.lit(g) for g in range(ARRIVALS)])))
    rows = rows.filter((line + p + F.col("g")) % 4 != 0)
    lost = (F.col("info_type") == "pricing_item") & (supp % 5 == 4)
    return (rows.withColumn("program", F.when(lost, F.concat(F.lit("unlisted zone "), supp.cast("string"))).otherwise(F.col("program")))
            .withColumn("notes", F.when((F.col("g") == 2) & (supp % 3 == 0), "moved").otherwise(F.col("notes"))))


def arrived(spark, d) -> jobs.TermArrival:
    programs, items = views.catalog_programs(spark, d), views.catalog_items(spark, d)
    return arriving(spark, readings(spark, d), "records", F.col("g"),
                    lambda stream, state: jobs.term_arrival(stream.drop("g"), programs, items, state, BUCKETS))


@query("K3_term_arrival", uses="records", sql=f"""{READING_SQL},
 steps as (select *, lag(body) over w as was, first_value(review) over w as first_review, first_value(g) over w as first_g
  from fresh window w as (partition by document_id, version, record_id order by g))
select document_id, version, record_id, arg_max(term_category, s.g) as category, max(s.g) <> l.g as superseded,
 bool_or(first_review or was <> body) as needs_review, min(first_g)::bigint as created_in
from steps s join last_read l using (document_id, version) group by document_id, version, record_id, l.g""")
def term_arrival(spark, d):
    """Three readings of every document, merged batch by batch."""
    return arrived(spark, d).terms.rows().select(
        "document_id", "version", "record_id", "category", "superseded", "needs_review", "created_in")


@query("K3_arrival_effects", uses="records", sql=f"""{READING_SQL},
 filed as (select o_orderkey as document_id, o_custkey as engagement_id, (1 + o_orderkey % 2)::int as current_version
  from orders where o_orderstatus <> 'P'),
 live as (select f.* from fresh f join last_read using (document_id, version, g)),
 covered as (select document_id, version, program, count(*) filter (amount is not null or coalesce(calculation, '') <> '')
   as priced from live where term_category = 'pricing' and program not like 'unlisted%' group by all),
 sighted as (select distinct document_id, version, g, program from fresh
  where term_category = 'pricing' and program like 'unlisted%')
select 'coverage' as effect, document_id::varchar as name, count(*)::bigint as rows, sum(priced)::bigint as total
 from covered group by document_id
union all select 'unmatched', {sql_norm('program')}, count(*)::bigint,
 (least(5, count(distinct document_id)) + 10 * min(g) + 100 * max(g))::bigint from sighted group by 2
union all select 'ready', engagement_id::varchar, count(*)::bigint, bool_and(version is not null)::bigint
 from filed left join (select distinct document_id, version from fresh) x on x.document_id = filed.document_id
  and version = current_version group by engagement_id""")
def arrival_effects(spark, d):
    """What arrival keeps beside the terms: coverage, the queue of unmatched names, and who may go on."""
    tables = arrived(spark, d)
    filed = views.table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("engagement_id"),
        (1 + F.col("o_orderkey") % 2).cast("int").alias("current_version"), F.lit("CURRENT").alias("standing"))
    text = lambda c: F.col(c).cast("string").alias("name")
    covered = tables.coverage.rows().groupBy("document_id").agg(
        F.count("*").alias("rows"), F.sum("priced_items").alias("total"))
    ready = tables.ready(filed).join(filed.groupBy("engagement_id").agg(F.count("*").alias("rows")), "engagement_id")
    queue = tables.unmatched.rows()
    return (covered.select(F.lit("coverage").alias("effect"), text("document_id"), "rows", "total")
            .unionByName(queue.select(F.lit("unmatched").alias("effect"), text("normalised"), F.col("seen").alias("rows"), (
                F.size("examples") + 10 * F.col("first_seen") + 100 * F.col("last_seen")).cast("long").alias("total")))
            .unionByName(ready.select(F.lit("ready").alias("effect"), text("engagement_id"), "rows",
                                      F.col("all_extracted").cast("long").alias("total"))))


@query("K4_notification_outbox", uses="audit_events memberships", sql=ov.OUTBOX_SQL)
def notification_outbox(spark, d):
    stream = views.audit_events_of(jobs.arrivals(spark, d, "events")).withColumnRenamed(
        "submission_id", "engagement_id")
    return jobs.notification_outbox(stream, views.memberships(spark, d))


@query("K5_unmatched_counter", uses=UNPLACED, sql=f"""
select {sql_norm('raw')} as normalised, count(*) as seen from raw_names where raw in (from unplaced) group by 1""")
def unmatched_counter(spark, d):
    programs, items = views.catalog_programs(spark, d), views.catalog_items(spark, d)
    return arriving(spark, views.raw_names(spark, d).select("raw", "engagement_id"), "names",
                    F.pmod(F.col("engagement_id"), F.lit(ARRIVALS)),
                    lambda stream, state: jobs.unmatched_counter(stream, programs, items, state, BUCKETS))
