"""Continuous jobs. Each runs over what has arrived and stops, and can be rerun at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallypact.functions.documents import sanity_reasons
from tallypact.functions.text import normalise_name
from tallypact.operators.records import last_by
from tallypact.plans import catalog, documents, lifecycle, people, terms
from tallypact.session import cut_lineage, discard, durable_dir
from tallypact.sources.batch_table import PLACE, BatchTable


def arrivals(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000):
    """New rows of one table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", f"{name}.parquet").parquet(folder))


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], state: str,
                  mode: str = "append") -> None:
    """Process everything that has arrived, batch by batch, and stop."""
    (stream.writeStream.outputMode(mode).foreachBatch(batch)
     .option("checkpointLocation", f"{state}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def append_available(stream: DataFrame, state: str) -> str:
    """Append everything that has arrived to a table; returns its path."""
    path = f"{state}/table"
    (stream.writeStream.outputMode("append").format("parquet").option("path", path)
     .option("checkpointLocation", f"{state}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return path


def _write_batch(df: DataFrame, path: str, epoch: int) -> None:
    """A batch in its own folder, overwritten when the batch is retried."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


CLASSIFIED = ["document_id", "engagement_id", "doc_type", "confidence", "effective_date", "created_ord"]


def document_arrival(texts: DataFrame, state: str | None = None, buckets: int = 64) -> DataFrame:
    """Arriving agreements are classified, checked if they were uploaded again, and given their standing.

    ``texts`` is a stream with document_id, engagement_id, full_text and created_ord; with ``client_name``,
    ``expected`` and ``reupload`` the text of a re-upload must name its client and fit its slot. A document that does not is
    ``refused`` with reasons; as a document it still competes for standing.

    What is kept between batches is the newest document per engagement and type. A batch reads and rewrites that for
    the keys it brings, and never the documents that came before.
    """
    spark = texts.sparkSession
    state = state or durable_dir(spark, "document-arrival")
    read = f"{state}/classified"
    newest = BatchTable(spark, f"{state}/newest", "engagement_id bigint, doc_type string, effective string, created_ord bigint, "
                        "document_id bigint", ["engagement_id", "doc_type"], buckets)
    order = F.struct("effective", "created_ord", "document_id")

    def combine(old: DataFrame, batch: DataFrame) -> DataFrame:
        return last_by(old.unionByName(batch.select(*old.columns)), ["engagement_id", "doc_type"], order,
                       ["effective", "created_ord", "document_id"])

    def batch(df: DataFrame, epoch: int) -> None:
        checked = df
        if "reupload" in df.columns:
            reasons = F.when(F.col("reupload"), sanity_reasons(F.col("full_text"), F.col("client_name"), F.col("expected")))
            checked = df.withColumn("reasons", F.array_join(F.coalesce(reasons, F.array().cast("array<string>")), "; "))
        else:
            checked = df.withColumn("reasons", F.lit(""))
        status = F.when(F.col("reasons") == "", "parsed").otherwise("refused")
        _write_batch(documents.classify(checked).select(*CLASSIFIED, status.alias("version_status"), "reasons"), read, epoch)
        mine = spark.read.parquet(f"{read}/epoch={epoch}").filter("doc_type <> 'UNKNOWN'")
        effective = F.coalesce(F.col("effective_date").cast("string"), F.lit(""))
        newest.merge(epoch, mine.withColumn("effective", effective), combine)

    run_available(texts, batch, state)
    winners = newest.rows().select("document_id", F.lit(True).alias("wins"))
    wins = (F.col("doc_type") == "UNKNOWN") | F.col("wins").isNotNull()
    return (spark.read.parquet(read).drop("epoch").join(winners, "document_id", "left")
            .withColumn("ranked_standing", F.when(wins, "CURRENT").otherwise("SUPERSEDED")).drop("wins"))


def lifecycle_state(events: DataFrame, state: str | None = None, buckets: int = 64) -> DataFrame:
    """Status of every submission, kept between batches while events stream in.

    ``events`` is a stream with submission_id, ts, event_id, action and actor_role. The result has
    every event with the status before and after it. A batch's events are composed into maps from status to status, chunk by
    chunk (``lifecycle.replay``), so a submission with most of a batch's events is many tasks; only its
    status is carried on. Events that arrive later are applied when they arrive, whatever their time.
    """
    spark = events.sparkSession
    state = state or durable_dir(spark, "lifecycle")
    kept = BatchTable(spark, f"{state}/status", "submission_id bigint, status string", ["submission_id"], buckets)
    out = f"{state}/events"

    def combine(old: DataFrame, batch: DataFrame) -> DataFrame:
        return old.join(batch, "submission_id", "left_anti").unionByName(batch)

    def batch(df: DataFrame, epoch: int) -> None:
        df = cut_lineage(df, "events")
        start = kept.before(epoch, df.select("submission_id").distinct())
        replayed = lifecycle.replay(df, start)
        _write_batch(replayed.select("submission_id", "event_id", "ts", "status_before", "accepted", "status_after"), out, epoch)
        final = lifecycle.final_status(spark.read.parquet(f"{out}/epoch={epoch}")).withColumnRenamed("status_after", "status")
        kept.merge(epoch, cut_lineage(final, "statuses"), combine)

    run_available(events, batch, state)
    return spark.read.parquet(out).drop("epoch", "ts")


class TermArrival:
    """The tables that arriving readings keep up to date: terms, coverage, unmatched names, extracted versions.

    Records of a document version arrive as whole readings. A reading is materialised and merged with what is stored for
    its document versions: approvals and corrections of terms that did not change survive, changed terms are flagged, terms
    that are gone are superseded. Coverage of these versions is rebuilt, names the catalog cannot place are queued, and the
    versions count as extracted. Each batch rewrites only the buckets it touches; retried batches change nothing.
    """

    def __init__(self, spark: SparkSession, records: StructType, state: str | None = None, buckets: int = 64):
        self.state = state or durable_dir(spark, "term-arrival")
        of = {f.name: f.dataType.simpleString() for f in records}

        def made(name, schema, key):
            return BatchTable(spark, f"{self.state}/{name}", schema, key, buckets)

        self.terms = made("terms", f"{terms.stored_schema(records)}, {terms.REVIEW_STATE}", ["document_id"])
        version = ", ".join(f"{c} {of[c]}" for c in terms.DOCUMENT)
        self.coverage = made("coverage", f"{version}, {terms.COVERAGE}", ["document_id"])
        self.unmatched = made("unmatched", catalog.QUEUE, ["normalised"])
        self.versions = made("versions", f"document_id {of['document_id']}, version {of['version']}, status string", ["document_id"])

    def apply(self, fresh: DataFrame, epoch: int) -> None:
        """One batch of materialised readings, written out beforehand."""
        self.terms.merge(epoch, fresh, lambda old, new: terms.apply_reading(old, new, F.lit(epoch), PLACE), dealt=True)
        self.coverage.merge(epoch, fresh, terms.replace_coverage)
        names = terms.unmatched_names(fresh).select(
            "raw", F.col("document_id").cast("string").alias("example"), F.lit(epoch).alias("seen_at"))
        self.unmatched.merge(epoch, cut_lineage(catalog.queue_of(names), "names"), catalog.merge_queue)
        read = fresh.select("document_id", "version").distinct().withColumn("status", F.lit("extracted"))
        self.versions.merge(epoch, read, lambda old, new: old.unionByName(new.select(*old.columns)).distinct())

    def approve(self, decided: DataFrame) -> None:
        """Analysts' decisions between two batches."""
        self.terms.edit(decided, terms.approve)

    def ready(self, filed: DataFrame) -> DataFrame:
        """Per engagement whether every document in force has been extracted; ``filed`` is the documents table."""
        return documents.all_extracted(filed, self.versions.rows())


def term_arrival(records: DataFrame, programs: DataFrame, items: DataFrame, state: str | None = None,
                 buckets: int = 64) -> TermArrival:
    """Arriving records are materialised and merged with the terms stored so far; see :class:`TermArrival`."""
    spark = records.sparkSession
    tables = TermArrival(spark, records.schema, state, buckets)

    def batch(df: DataFrame, epoch: int) -> None:
        fresh = cut_lineage(terms.materialise(df, programs, items), "fresh")
        tables.apply(fresh, epoch)
        discard(fresh)

    run_available(records, batch, tables.state)
    return tables


def notification_outbox(events: DataFrame, memberships: DataFrame) -> DataFrame:
    """Arriving transition events as (template, recipient) rows."""
    spark = events.sparkSession
    stream = people.outbox(events, memberships)
    return spark.read.parquet(append_available(stream, durable_dir(spark, "outbox")))


def unmatched_counter(names: DataFrame, programs: DataFrame, items: DataFrame, state: str | None = None,
                      buckets: int = 64) -> DataFrame:
    """Running count per name that the catalog cannot place; each batch writes only the names it moved.

    ``names`` is a stream with raw. A batch's distinct names are resolved before they are counted.
    """
    spark = names.sparkSession
    state = state or durable_dir(spark, "unmatched")
    counted = BatchTable(spark, f"{state}/counts", "normalised string, seen bigint", ["normalised"], buckets)

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("normalised").agg(F.sum("seen").alias("seen"))

    def batch(df: DataFrame, epoch: int) -> None:
        seen = cut_lineage(df.groupBy("raw").agg(F.count("*").alias("n")), "names")
        unplaced = catalog.unplaced(seen, programs, items)
        counts = unplaced.groupBy(normalise_name(F.col("raw")).alias("normalised")).agg(F.sum("n").alias("seen"))
        counted.merge(epoch, cut_lineage(counts, "counts"), combine)

    run_available(names, batch, state)
    return counted.rows()


__all__ = ["TermArrival", "arrivals", "document_arrival", "lifecycle_state", "notification_outbox",
           "term_arrival", "unmatched_counter"]
