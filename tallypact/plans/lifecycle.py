"""Review cycles and the replay of lifecycle events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import lifecycle as lc
from tallypact.operators.ordered import CHUNK, in_chunks
from tallypact.operators.records import last_by
from tallypact.plans.documents import stored_slots


def _cycle_order(preferred: Column) -> Column:
    return F.struct(preferred.cast("int"), F.col("cycle"), F.col("created_at"),
                    F.col("submission_id"))


def _cycle_columns(cycles: DataFrame) -> list[str]:
    return [c for c in cycles.columns if c != "engagement_id"]


def cycle_in_force(cycles: DataFrame) -> DataFrame:
    """Per engagement the latest cycle to go live, else the latest opened."""
    return last_by(cycles, ["engagement_id"], _cycle_order(F.col("status") == "ACTIVE"),
                   _cycle_columns(cycles))


def open_cycle(cycles: DataFrame) -> DataFrame:
    """Per engagement the cycle still running, else the latest."""
    return last_by(cycles, ["engagement_id"], _cycle_order(F.col("status") != "ACTIVE"),
                   _cycle_columns(cycles))


def live_cycle(cycles: DataFrame) -> DataFrame:
    """Per engagement the latest live cycle; engagements without one are absent."""
    return last_by(cycles.filter("status = 'ACTIVE'"), ["engagement_id"],
                   _cycle_order(F.lit(1)), _cycle_columns(cycles))


def next_cycle(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("engagement_id").agg((F.max("cycle") + 1).alias("next_cycle"))


def status_follow_through(engagements: DataFrame, cycles: DataFrame,
                          changes: DataFrame) -> DataFrame:
    """Engagement status after cycles change status.

    ``changes`` has engagement_id, submission_id, new_status, at most one row per engagement. The
    engagement follows a cycle that goes live, and any cycle while no other one is live.
    """
    live = cycles.groupBy("engagement_id").agg(
        F.count_if(F.col("status") == "ACTIVE").alias("live"))
    before = cycles.select("engagement_id", "submission_id",
                           (F.col("status") == "ACTIVE").cast("int").alias("was_live"))
    decided = (changes.join(before, ["engagement_id", "submission_id"])
               .join(live, "engagement_id")
               .withColumn("other_live", F.col("live") - F.col("was_live") > 0)
               .filter((F.col("new_status") == "ACTIVE") | ~F.col("other_live"))
               .select("engagement_id", "new_status"))
    return (engagements.join(decided, "engagement_id", "left")
            .withColumn("status", F.coalesce("new_status", "status")).drop("new_status"))


def amendment_eligibility(cycles: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether an amendment may be opened, and whether the open one may be discarded.

    ``documents`` has engagement_id and the cycle each agreement arrived in.
    """
    current = open_cycle(cycles)
    own = documents.select("engagement_id", "cycle").distinct().withColumn(
        "has_documents", F.lit(True))
    refusal = (F.when(F.col("cycle") <= 1, "the original review cycle cannot be discarded")
               .when(F.col("status") != "DRAFT", F.concat(F.lit(
                   "an amendment can only be discarded before it starts, not while "),
                   F.col("status")))
               .when(F.col("has_documents"),
                     "remove the agreements uploaded to this amendment before discarding it"))
    return (current.join(next_cycle(cycles), "engagement_id")
            .join(own, ["engagement_id", "cycle"], "left")
            .select("engagement_id", "submission_id", "status", "cycle", "next_cycle",
                    lc.can_amend(F.col("status")).alias("can_open"),
                    refusal.alias("discard_refused")))


def open_amendments(cycles: DataFrame) -> DataFrame:
    """The draft that opens on every engagement whose current cycle may be amended.

    It starts from the agreements of the cycle it amends: ``cycles`` has the map document_ids and the older fields
    msa_document_id and mla_document_id, and the draft's map is made of either.
    """
    held = cycles.select("submission_id", stored_slots(
        F.col("document_ids"), F.col("msa_document_id"), F.col("mla_document_id")).alias("document_ids"))
    slim = cycles.select("engagement_id", "submission_id", "cycle", "created_at", "status")
    return (open_cycle(slim).filter(lc.can_amend(F.col("status")))
            .join(next_cycle(slim), "engagement_id").join(held, "submission_id")
            .select("engagement_id", F.col("submission_id").alias("amends"), F.col("next_cycle").alias("cycle"),
                    F.lit("DRAFT").alias("status"), "document_ids"))


def document_eligibility(current: DataFrame) -> DataFrame:
    """What may be done with an engagement's agreements in the status of its open cycle."""
    status = F.coalesce("status", F.lit("DRAFT"))
    may_touch = status.isin(fv.OPEN_FOR_DOCUMENTS)
    action = (F.when(status == "DRAFT", "submit_for_processing")
              .when(status.isin("IN_UNDERWRITING", "VALIDATION_FAILED",
                                "CHANGES_REQUESTED_CLIENT"), "reupload"))
    refusal = F.when(
        ~may_touch,
        F.when(status == "ACTIVE",
               "this engagement is live — open an amendment to add or renew an agreement")
        .otherwise(F.concat(F.lit("agreements cannot be uploaded while the submission is "),
                            status)))
    return current.select(
        "engagement_id", status.alias("status"), may_touch.alias("can_upload"),
        may_touch.alias("can_delete"), status.isin(fv.OPEN_FOR_EXTRACTION).alias("can_extract"),
        action.alias("extract_action"), refusal.alias("upload_refused"))


def migrate_statuses(cycles: DataFrame) -> DataFrame:
    """Retired statuses mapped to current ones; cycles landing in setup are billed at once."""
    chain = None
    for old, new in fv.RETIRED_STATUSES.items():
        hit = F.col("status") == old
        chain = F.when(hit, new) if chain is None else chain.when(hit, new)
    return (cycles.withColumn("migrated_to", chain)
            .withColumn("to_bill", F.coalesce(F.col("migrated_to") == "BILLING_SETUP",
                                              F.lit(False)))
            .withColumn("new_status", F.when(F.col("to_bill"), "PENDING_BILLING_AUDIT")
                        .otherwise(F.coalesce("migrated_to", "status"))))


def status_since(engagements: DataFrame, cycles: DataFrame) -> DataFrame:
    """Since when an engagement has its status: its cycle's last change, else its own creation."""
    changed = cycle_in_force(cycles).select("engagement_id", "updated_at")
    return (engagements.join(changed, "engagement_id", "left")
            .withColumn("status_since", F.coalesce("status_since", "updated_at", "created_at"))
            .drop("updated_at"))


# --- replay ----------------------------------------------------------------------------------
def _apply(state: Column, event: Column) -> Column:
    return F.call_function("translate", state, event.src, event.dst)


def _ordered_chunks(events: DataFrame) -> DataFrame:
    """Events with their moves, numbered into chunks of at most CHUNK rows in order of time."""
    src, dst = lc.moves(F.col("action"), F.col("actor_role"))
    slim = events.select("submission_id", "ts", "event_id", "action", "actor_role",
                         src.alias("src"), dst.alias("dst"))
    return in_chunks(slim, ["submission_id", "ts", "event_id"], CHUNK, "replay-chunks")


def _entry_states(chunks: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """State of each submission at the start of each of its chunks.

    A chunk acts on the machine as a map from every status to a status, held as one string with a
    letter per status, and maps compose. Runs of CHUNK chunks are composed until a submission has
    few runs left; those are walked in order, and the answer is carried back down.
    """
    per_submission = chunks.groupBy("submission_id").agg(F.count("*").alias("n"))
    most = per_submission.agg(F.max("n")).first()[0] or 0
    if most > CHUNK:
        runs = chunks.withColumn("run", F.floor(F.col("chunk") / CHUNK))
        composed = (runs.groupBy("submission_id", "run")
                    .agg(F.array_sort(F.collect_list(F.struct("chunk", "effect"))).alias("maps"))
                    .select("submission_id", F.col("run").alias("chunk"), "maps",
                            _compose("maps").alias("effect")))
        upper = _entry_states(composed.drop("maps"), start)
        return _walk(composed.drop("effect").join(upper, ["submission_id", "chunk"]))
    whole = chunks.groupBy("submission_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "effect"))).alias("maps"))
    if start is None:
        return _walk(whole.withColumn("entry", F.lit(lc.LETTERS["DRAFT"])))
    letter = lc.status_letter(F.col("status"))
    begun = start.select("submission_id", letter.alias("entry"))
    return _walk(whole.join(begun, "submission_id", "left").withColumn(
        "entry", F.coalesce("entry", F.lit(lc.LETTERS["DRAFT"]))))


def _compose(maps: str) -> Column:
    return F.aggregate(maps, F.lit(lc.IDENTITY), lambda acc, m: F.call_function(
        "translate", acc, F.lit(lc.IDENTITY), m.effect))


def _walk(df: DataFrame) -> DataFrame:
    """Entry state of every chunk of ``maps``, starting from ``entry``."""
    start = F.struct(F.col("entry").alias("state"),
                     F.array().cast("array<struct<chunk:bigint,entry:string>>").alias("out"))
    walked = F.aggregate("maps", start, lambda acc, m: F.struct(
        F.call_function("translate", acc.state, F.lit(lc.IDENTITY), m.effect).alias("state"),
        F.concat(acc.out, F.array(F.struct(m.chunk.alias("chunk"), acc.state.alias("entry"))))
        .alias("out")))
    return (df.select("submission_id", F.explode(walked.out).alias("e"))
            .select("submission_id", "e.chunk", "e.entry"))


def replay(events: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Every event with the status before and after it, and why it was refused if it was.

    A submission starts from its status in ``start`` (submission_id, status), else as a draft.
    """
    numbered = _ordered_chunks(events)
    packed = (numbered.groupBy("submission_id", "chunk")
              .agg(F.array_sort(F.collect_list(
                  F.struct("ts", "event_id", "action", "actor_role", "src", "dst")))
                  .alias("events")))
    effects = packed.select("submission_id", "chunk", F.aggregate(
        "events", F.lit(lc.IDENTITY), _apply).alias("effect"))
    entries = _entry_states(effects, start)
    start = F.struct(F.col("entry").alias("state"),
                     F.array().cast("array<string>").alias("before"))
    states = F.aggregate("events", start, lambda acc, e: F.struct(
        _apply(acc.state, e).alias("state"),
        F.concat(acc.before, F.array(acc.state)).alias("before"))).before
    rows = (packed.join(entries, ["submission_id", "chunk"])
            .select("submission_id", F.explode(F.arrays_zip(
                F.col("events"), states.alias("before"))).alias("z"))
            .select("submission_id", "z.events.*", "z.before"))
    legal = F.contains(F.col("src"), F.col("before"))
    known = F.contains(lc.action_moves(F.col("action")), F.col("before"))
    after = F.call_function("translate", F.col("before"), F.col("src"), F.col("dst"))
    status_before = lc.letter_status(F.col("before"))
    reason = (F.when(legal, F.lit(None).cast("string"))
              .when(known, F.concat(F.lit("role "), F.col("actor_role"),
                                    F.lit(" may not perform "), F.col("action")))
              .otherwise(F.concat(F.col("action"), F.lit(" is not allowed from "),
                                  status_before)))
    return rows.select(
        "submission_id", "event_id", "ts", "action", "actor_role",
        status_before.alias("status_before"), legal.alias("accepted"),
        lc.letter_status(after).alias("status_after"), reason.alias("reason"))


def final_status(replayed: DataFrame) -> DataFrame:
    """Status of each submission after its last event."""
    return last_by(replayed, ["submission_id"], F.struct("ts", "event_id"), ["status_after"])
