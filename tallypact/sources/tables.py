"""Entity tables, catalog files, workbook sheets and the tables that jobs write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypact.functions.text import slugify

# Columns a storage layer adds to every row; no operator reads them.
STORAGE_COLUMNS = ["PK", "SK", "GSI1PK", "GSI1SK", "GSI2PK", "GSI2SK"]

# sheet -> (record type, {column heading: record field})
WORKBOOK_SHEETS = {
    "Pricing Items": ("pricing_item", {
        "Program": "program", "Product / Service": "product_service", "Item": "item",
        "SubCategory": "sub_category", "Frequency": "frequency", "Amount": "amount",
        "Calculation": "calculation"}),
    "SLA Items": ("sla_item", {
        "Contract Sub-Section": "contract_sub_section", "Category": "category",
        "Service Level Standard": "service_level_standard", "Frequency*": "frequency",
        "Minimum Threshold": "minimum_threshold", "Calculation": "calculation",
        "Example": "example"}),
    "Reporting Requirements": ("reporting_requirement", {
        "Report Name": "report_name", "Report Specifications": "report_specifications",
        "Frequency": "frequency", "Applicable Program": "applicable_programs"}),
    "Misc - Definitions": ("definition", {"Term": "term", "Definition": "definition"}),
    "Misc - Online Tools": ("online_tool", {
        "Platform": "platform", "Online Tool": "tool_name", "Description": "description"}),
    "Misc - Responsibilities": ("responsibility", {
        "Topic": "topic", "Task": "task", "Responsible Party": "responsible_party",
        "Timing": "timing", "Frequency": "frequency"}),
    "Misc - Signatures": ("signature", {
        "Company": "company", "Date": "signed_date_raw", "Name": "name", "Title": "title"}),
    "Misc - Information Section": ("information_section", {
        "Topic": "topic", "Description": "description"}),
    "Misc - TBD": ("uncategorised", {"Item": "item", "TBD": "detail"}),
}
SHARED_HEADINGS = {"Contract Section": "contract_section", "Notes": "notes",
                   "Context (Contract snipet)": "quote", "Info Type": "sheet_info_type"}
LIST_FIELDS = ["applicable_programs"]


def write_entities(tables: dict[str, DataFrame], path: str) -> None:
    """Entity tables in one store, a folder per type, so reading one type prunes the others."""
    for kind, df in tables.items():
        df.write.mode("append").parquet(f"{path}/type={kind}")


def load_entity(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """Typed rows of one entity, without the columns storage added."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    keep = [c for c in rows.columns if c not in STORAGE_COLUMNS + ["type"]]
    return rows.filter(F.col("type") == kind).select(*keep)


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(programs, items) of nested catalog JSON; ids derive from names where they are absent."""
    schema = ("program_id string, name string, category string, aliases array<string>, "
              "items array<struct<item_id:string,name:string,aliases:array<string>>>")
    nested = spark.read.schema(schema).json(path).withColumn(
        "program_id", F.coalesce("program_id", slugify(F.col("name"))))
    items = nested.select("program_id", F.explode("items").alias("i")).select(
        "program_id", F.coalesce("i.item_id", slugify(F.col("i.name"))).alias("item_id"),
        "i.name", "i.aliases")
    return nested.drop("items"), items


def import_sheet(rows: DataFrame, sheet: str) -> DataFrame:
    """A workbook sheet as records. Blank cells are NULL, joined cells arrays, and ``Included``
    a flag."""
    info_type, mapping = WORKBOOK_SHEETS[sheet]
    renames = {**mapping, **SHARED_HEADINGS}
    known = rows.select(*[c for c in rows.columns if c in renames]).withColumnsRenamed(renames)
    clean = known.select(*[
        F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in known.columns])
    out = clean.filter(F.coalesce(*[F.col(c) for c in clean.columns]).isNotNull())
    out = out.withColumn("info_type", F.lit(info_type))
    for c in LIST_FIELDS:
        if c in out.columns:
            parts = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda p: p != "")
            out = out.withColumn(c, F.coalesce(parts, F.array().cast("array<string>")))
    if info_type == "uncategorised":
        labels = [c for c in ("item", "contract_section", "sheet_info_type") if c in out.columns]
        out = out.withColumn("item", F.coalesce(*labels))
    if info_type == "pricing_item":
        said = (F.lower(F.coalesce("notes", F.lit(""))) == "included") | (
            F.lower(F.coalesce("amount", F.lit(""))) == "included")
        out = out.withColumn("included", said).withColumn(
            "amount", F.expr("try_cast(amount as decimal(18,2))"))
    return out.drop("sheet_info_type")


def import_workbook(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets as one table of records."""
    out = None
    for sheet, rows in sheets.items():
        part = import_sheet(rows, sheet)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def money(col: Column) -> Column:
    """Money as stored: exact to the cent."""
    return col.cast("decimal(18,2)")


def write_billing_configs(header: DataFrame, lines: DataFrame, path: str) -> None:
    """Headers and lines as JSON, partitioned so one engagement is read without the others."""
    bucket = F.pmod(F.xxhash64("engagement_id"), F.lit(64)).cast("int")
    for name, rows in (("headers", header), ("lines", lines)):
        rows.withColumn("bucket", bucket).write.partitionBy("bucket").json(f"{path}/{name}")


def write_extraction(records: DataFrame, run: DataFrame, path: str) -> None:
    """Records by category and the run's telemetry, side by side under one folder."""
    records.write.partitionBy("category").parquet(f"{path}/records")
    run.write.parquet(f"{path}/runs")
