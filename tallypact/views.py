"""Domain tables derived from the supplied parquet tables, one function per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypact.fixed_values import BODY_CLASSES
from tallypact.functions.binding import let
from tallypact.operators.ordered import with_position

AS_OF = "2000-06-30"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


#: Session setting: tables read from single files are dealt to so many tasks before anything else.
#: Unset on a cluster, where a table has many files.
SPREAD = "spark.tallypact.spread"
SPREAD_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks), SPREAD_KEYS[name]) if tasks and name in SPREAD_KEYS else df


def by_value(col: Column, mapping: dict, default=None) -> Column:
    """A CASE over a handful of fixed codes."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(F.lit(default))


def customers(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("legal_name"),
            F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("country"),
            F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE").alias("status"))
    )


def engagements(spark, sf_dir):
    priority = F.col("o_orderpriority")
    in_review = by_value(priority, {
        "1-URGENT": "PENDING_CLIENT_APPROVAL", "2-HIGH": "CHANGES_REQUESTED_CLIENT",
        "3-MEDIUM": "CLIENT_APPROVED", "4-NOT SPECIFIED": "BILLING_SETUP",
    }, "PENDING_BILLING_AUDIT")
    early = by_value(priority, {
        "1-URGENT": "DRAFT", "2-HIGH": "EXTRACTING", "3-MEDIUM": "IN_UNDERWRITING",
        "4-NOT SPECIFIED": "REVALIDATING",
    }, "VALIDATION_FAILED")
    opened = F.col("o_orderdate").cast("date")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        table(spark, sf_dir, "orders")
        .join(names, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("engagement_id"), F.col("o_custkey").alias("customer_id"),
            F.col("c_name").alias("client_name"), opened.alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", "ACTIVE")
            .when(F.col("o_orderstatus") == "O", in_review).otherwise(early).alias("status"),
            by_value(F.col("o_orderkey") % 3, {0: "monthly", 1: "quarterly"}, "annual")
            .alias("billing_frequency"),
            opened.alias("billing_start"),
            (12 * (1 + F.col("o_orderkey") % 5)).cast("int").alias("contract_term_months"),
            F.when(F.col("o_orderkey") % 4 != 0, F.floor(F.col("o_totalprice") / 5000))
            .cast("int").alias("fleet_size_override"))
    )


def submissions(spark, sf_dir):
    """Review cycles numbered in order of opening; a customer is the engagement here."""
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return with_position(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "cycle").select(
        F.col("o_custkey").alias("engagement_id"), F.col("o_orderkey").alias("submission_id"),
        F.col("cycle").cast("int"),
        F.col("o_orderdate").cast("date").alias("created_at"),
        by_value(F.col("o_orderstatus"), {"F": "ACTIVE", "O": "PENDING_CLIENT_APPROVAL"}, "DRAFT")
        .alias("status"))


def line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def review_cycles(spark, sf_dir):
    """Cycles per engagement of ``engagements``: one per order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("engagement_id"), line_id().alias("submission_id"),
        F.col("l_linenumber").cast("int").alias("cycle"),
        F.col("l_shipdate").cast("date").alias("created_at"),
        by_value(F.col("l_returnflag"), {"A": "ACTIVE", "N": "PENDING_CLIENT_APPROVAL"}, "DRAFT")
        .alias("status"))


def with_parts(spark, sf_dir, lines: DataFrame) -> DataFrame:
    """Order lines, arriving or stored, beside the part they name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _lines_with_parts(spark, sf_dir):
    return with_parts(spark, sf_dir, table(spark, sf_dir, "lineitem"))


FREQUENCY_BY_LINE = {
    1: "pvpm", 2: "per vehicle per month", 3: "per driver per month", 4: "per card",
    5: "per claim", 6: "one-time",
}


def pricing_terms(spark, sf_dir):
    return _lines_with_parts(spark, sf_dir).select(
        F.col("l_orderkey").alias("engagement_id"), F.col("l_orderkey").alias("document_id"),
        (1 + F.col("l_suppkey") % 2).cast("int").alias("version"),
        F.concat("p_name", F.lit(" Program")).alias("program"), F.col("p_brand").alias("item"),
        by_value(F.col("l_linenumber"), FREQUENCY_BY_LINE, "rebate per litre").alias("frequency"),
        (F.col("l_discount") * 100).cast("decimal(18,2)").alias("amount"),
        (F.col("l_tax") * 100).cast("decimal(18,2)").alias("rate_pct"),
        (1 - F.col("l_tax") * 3).cast("decimal(4,2)").alias("confidence"),
        (F.col("l_returnflag") == "A").alias("approved"),
        (F.col("l_returnflag") == "R").alias("superseded"),
        line_id().alias("term_key"), F.col("l_linenumber"), F.col("l_suppkey"),
        F.col("l_partkey"), F.col("l_quantity"))


def programs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def raw_names(spark, sf_dir):
    return raw_names_of(_lines_with_parts(spark, sf_dir))


def raw_name() -> Column:
    """The wording an extraction observed; reads the columns of a line with its part."""
    name = F.col("p_name")
    size = F.length(name)
    return (
        F.when(F.col("l_suppkey") % 5 == 0, name)
        .when(F.col("l_suppkey") % 5 == 1, F.concat(F.upper(name), F.lit(" PROGRAM (SECTION 2)")))
        .when(F.col("l_suppkey") % 5 == 2, F.concat(name, F.lit(" Services")))
        .when(F.col("l_suppkey") % 5 == 3,
              F.concat(F.substr(name, F.lit(1), size - 2), F.substr(name, size, F.lit(1))))
        .otherwise(F.concat(F.lit("unlisted "), F.col("p_type"))))


def raw_names_of(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("engagement_id"), raw_name().alias("raw"),
        F.col("p_brand").alias("item_raw"), line_id().alias("term_key"), "l_shipdate")


def vehicles(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    customer_owned = F.col("l_suppkey") % 4 == 0
    return line.select(
        line_id().alias("vehicle_id"),
        F.when(customer_owned, "CUSTOMER_OWNED").otherwise("PROVIDER_OWNED").alias("ownership"),
        F.when(F.col("l_returnflag") == "R", "RETIRED")
        .when(F.col("l_linestatus") == "O", "ASSIGNED")
        .when(F.col("l_returnflag") == "A", "IN_STOCK").otherwise("IN_MAINTENANCE")
        .alias("status"),
        by_value(F.col("l_partkey") % 14, dict(enumerate(BODY_CLASSES))).alias("body_class"),
        by_value(F.col("l_linenumber") % 4, {0: "ICE", 1: "HYBRID", 2: "PHEV"}, "BEV")
        .alias("powertrain"),
        F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")).alias("engagement_id"),
        F.when(customer_owned, 1 + F.col("l_partkey") % 1000).alias("owner_customer_id"),
        F.col("l_shipdate").cast("date").alias("assigned_at"))


ACTION_BY_EVENT = dict(enumerate([
    "submit_for_processing", "pipeline_done", "submit_to_client", "client_approve",
    "client_request_changes", "reupload", "resubmit_to_client", "sanity_pass", "sanity_fail",
    "capture_fields", "billing_ready",
]))


def audit_events(spark, sf_dir):
    return audit_events_of(table(spark, sf_dir, "events"))


def audit_events_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("submission_id"),
        by_value(F.col("event_id") % 12, ACTION_BY_EVENT, "approve_billing").alias("action"),
        by_value(F.col("event_type"), {
            "error": "system", "click": "client", "purchase": "finance"}, "provider")
        .alias("actor_role"),
        F.col("props").alias("comment"))


def memberships(spark, sf_dir):
    """Rows of people on engagements; names and phones are known on some rows only."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("engagement_id"), "user_id",
        by_value(F.col("event_type"), {"view": "provider", "purchase": "finance"}, "client")
        .alias("role"),
        F.concat(F.lit("user"), user, F.lit("@example.com")).alias("email"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Person "), user)).alias("name"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("555-"), F.lpad(user, 4, "0")))
        .alias("phone"))


def provider_directory(spark, sf_dir):
    """Staff listed at organisation level: one row per supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.concat(F.lit("staff"), F.col("s_suppkey").cast("string"), F.lit("@example.com"))
        .alias("email"),
        F.col("s_name").alias("name"))


def agreements(spark, sf_dir):
    return agreements_of(table(spark, sf_dir, "documents"))


def agreements_of(documents: DataFrame) -> DataFrame:
    lead = by_value(F.col("doc_id") % 5, {
        0: "MASTER LEASE AGREEMENT effective as of January 5, 2024. ",
        1: "Master Services Agreement dated as of 3 March 2022. ",
        2: "STATEMENT OF WORK Effective Date: 2021-07-01. ",
        3: "Master Service Agreement effective as of February 30, 2024; "
           "see master lease agreement. ",
    }, "")
    return documents.select(
        F.col("doc_id").alias("document_id"), F.floor(F.col("doc_id") / 20).alias("engagement_id"),
        F.concat(lead, F.col("text")).alias("full_text"), F.col("doc_id").alias("created_ord"))


def quotes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


MODEL_BY_CONVERSATION = {
    0: "global.anthropic.claude-sonnet-4-6", 1: "global.amazon.nova-2-lite-v1:0",
    2: "apac.amazon.nova-lite-v1:0",
}


def calls(spark, sf_dir):
    chars = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("call_no"),
        by_value(F.col("conv_id") % 4, MODEL_BY_CONVERSATION, "unknown-model").alias("model"),
        chars.cast("bigint").alias("input_tokens"),
        F.floor(chars / 4).cast("bigint").alias("output_tokens"),
        (chars * 2).cast("bigint").alias("cache_read_tokens"),
        F.floor(chars / 2).cast("bigint").alias("cache_write_tokens"),
        F.when(F.col("role") == "user", "tool_use").otherwise("max_tokens").alias("stop_reason"))


LINES_PER_PAGE = 5


def document_pages(spark, sf_dir):
    """One row per document; its pages are an array cut from the text five lines at a time.

    Pages stay inside the document's row, so page-level work needs no shuffle and is bounded by
    the size of one document.
    """
    # The text is split once, not once a page.
    pages = let(F.split("full_text", "\n"), lambda lines: F.transform(
        F.sequence(F.lit(1), F.ceil(F.size(lines) / F.lit(LINES_PER_PAGE)).cast("int")),
        lambda n: F.struct(
            n.alias("page_number"),
            F.slice(lines, (n - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)).alias("lines"))))
    return agreements(spark, sf_dir).select(
        "document_id", "engagement_id", pages.alias("pages"))


INFO_TYPE_BY_PART = {
    4: "sla_item", 5: "reporting_requirement", 6: "definition", 7: "online_tool",
    8: "responsibility", 9: "signature", 10: "information_section", 11: "uncategorised",
}


def records(spark, sf_dir):
    return records_of(_lines_with_parts(spark, sf_dir))


def records_of(lines: DataFrame) -> DataFrame:
    """Extracted records of all nine types in one wide table, one per order line."""
    kind = by_value(F.col("l_partkey") % 12, INFO_TYPE_BY_PART, "pricing_item")
    supp = F.col("l_suppkey")

    def for_types(col, *types):
        return F.when(kind.isin(*types), col)

    priced = F.when(supp % 4 != 0, F.col("p_brand"))
    frequency = by_value(F.col("l_linenumber"), FREQUENCY_BY_LINE, "rebate per litre")
    quote = F.when(F.col("l_partkey") % 13 != 0, F.col("p_type"))
    return lines.select(
        line_id().alias("ordinal"), F.col("l_orderkey").alias("engagement_id"),
        F.col("l_orderkey").alias("document_id"),
        (1 + supp % 2).cast("int").alias("version"), kind.alias("info_type"),
        for_types(F.concat("p_name", F.lit(" Program")), "pricing_item").alias("program"),
        F.coalesce(for_types(priced, "pricing_item"), for_types(F.col("p_type"), "uncategorised"))
        .alias("item"),
        F.lit(None).cast("string").alias("sub_category"),
        F.coalesce(for_types(frequency, "pricing_item"),
                   for_types(F.lit("Monthly"), "reporting_requirement")).alias("frequency"),
        F.when((kind == "pricing_item") & (supp % 5 != 0),
               (F.col("l_discount") * 100).cast("decimal(18,2)")).alias("amount"),
        F.when((kind == "pricing_item") & (supp % 7 == 0), "ten percent of charges")
        .alias("calculation"),
        F.when(kind == "pricing_item", supp % 11 == 0).alias("included"),
        F.when(kind == "pricing_item", (F.col("l_tax") * 100).cast("decimal(18,2)"))
        .alias("rate_pct"),
        F.lit(None).cast("array<struct<min_units:int,max_units:int,amount:decimal(18,2)>>")
        .alias("tier_bands"),
        for_types(F.col("p_name"), "sla_item").alias("category"),
        for_types(F.col("p_brand"), "sla_item").alias("contract_sub_section"),
        for_types(F.concat("p_name", F.lit(" Report")), "reporting_requirement")
        .alias("report_name"),
        for_types(F.col("p_name"), "definition").alias("term"),
        for_types(F.col("p_type"), "definition").alias("definition"),
        for_types(F.col("p_name"), "online_tool").alias("tool_name"),
        for_types(F.col("p_brand"), "online_tool").alias("platform"),
        for_types(F.col("p_brand"), "responsibility", "information_section").alias("topic"),
        for_types(F.col("p_name"), "responsibility").alias("task"),
        for_types(F.lit("Vendor"), "responsibility").alias("responsible_party"),
        for_types(F.concat(F.lit("Company "), (supp % 10).cast("string")), "signature")
        .alias("company"),
        for_types(F.col("p_name"), "signature").alias("name"),
        for_types(F.col("p_type"), "information_section").alias("description"),
        (1 - F.col("l_tax") * 3).cast("decimal(4,2)").alias("confidence"),
        F.when(quote.isNotNull(), F.array(F.struct(quote.alias("quote")))).alias("citations"),
        F.when(kind == "pricing_item", F.when(supp % 6 == 0, "fuzzy")
               .when(supp % 6 == 1, "unmatched").otherwise("exact")).alias("catalog_match"),
        F.when(supp % 8 == 0, "see schedule").alias("notes"),
        (F.col("l_returnflag") == "A").alias("approved"),
        (F.col("l_returnflag") == "R").alias("superseded"))


def catalog_programs(spark, sf_dir):
    """The service catalog: one program per part name, known by one alias."""
    from tallypact.functions.text import slugify

    return programs(spark, sf_dir).select(
        slugify(F.col("name")).alias("program_id"), F.col("name").alias("position"), "name",
        F.array(F.concat("name", F.lit(" Plan"))).alias("aliases"))


def catalog_items(spark, sf_dir):
    """Items of each program: the brands its parts come in."""
    from tallypact.functions.text import slugify

    return table(spark, sf_dir, "part").select("p_name", "p_brand").distinct().select(
        slugify(F.col("p_name")).alias("program_id"), slugify(F.col("p_brand")).alias("item_id"),
        F.col("p_brand").alias("position"), F.col("p_brand").alias("name"),
        F.array().cast("array<string>").alias("aliases"))
