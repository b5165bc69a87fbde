"""Agreements: which is in force, what is pending, and how pages are cut into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import documents as fn
from tallypact.functions.binding import let
from tallypact.functions.folds import fold_out
from tallypact.operators.records import last_by


def classify(documents: DataFrame) -> DataFrame:
    """Documents with type, confidence and effective date read off ``full_text``."""
    kind = fn.classify_doc_type(F.col("full_text"))
    return (documents.withColumn("kind", kind)
            .withColumn("effective_date", fn.effective_date(F.col("full_text")))
            .select("*", "kind.doc_type", "kind.confidence").drop("kind"))


def rank_standing(documents: DataFrame) -> DataFrame:
    """Documents with the standing they should have.

    Per engagement and type the newest effective date, then the latest upload, is CURRENT.
    UNKNOWN documents never compete. The winners come from an aggregate and join back on the
    document, so one engagement with most of the documents is no hot key.
    """
    newest = F.struct(F.coalesce(F.col("effective_date").cast("string"), F.lit("")),
                      F.col("created_ord"), F.col("document_id"))
    winners = last_by(documents.filter("doc_type <> 'UNKNOWN'"), ["engagement_id", "doc_type"],
                      newest, ["document_id"])
    winners = winners.select("document_id", F.lit(True).alias("wins"))
    current = (F.col("doc_type") == "UNKNOWN") | F.col("wins").isNotNull()
    return (documents.join(winners, "document_id", "left")
            .withColumn("ranked_standing",
                        F.when(current, "CURRENT").otherwise("SUPERSEDED")).drop("wins"))


def slots(ranked: DataFrame) -> DataFrame:
    """Per engagement its scope and the document in each slot; two slots at most."""
    live = ranked.filter("ranked_standing = 'CURRENT' and doc_type <> 'UNKNOWN'")
    return live.groupBy("engagement_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "document_id"))))
        .alias("slots"),
        fn.scope_of(F.bool_or(F.col("doc_type") == "MLA"),
                    F.bool_or(F.col("doc_type") == "MSA")).alias("scope"))


def stored_slots(document_ids: Column, msa: Column, mla: Column) -> Column:
    """The slot map of a cycle, from the two older scalar fields where the map is empty."""
    legacy = F.map_from_entries(F.filter(F.array(
        F.when(mla.isNotNull(), F.struct(F.lit("MLA").alias("key"), mla.alias("value"))),
        F.when(msa.isNotNull(), F.struct(F.lit("MSA").alias("key"), msa.alias("value")))),
        lambda e: e.isNotNull()))
    return F.when(F.size(document_ids) > 0, document_ids).otherwise(legacy)


def reconcile(documents: DataFrame, engagements: DataFrame) -> DataFrame:
    """What settles after an upload: one row per change of standing, scope or slots.

    ``documents`` has the stored ``standing``; ``engagements`` the stored ``scope`` and ``slots``
    (as text). Nothing is returned for rows that are right already.
    """
    ranked = rank_standing(documents)
    moved = ranked.filter(F.col("ranked_standing") != F.col("standing")).select(
        "engagement_id", F.col("document_id").cast("string").alias("subject"),
        F.lit("standing").alias("field"), F.col("standing").alias("old"),
        F.col("ranked_standing").alias("new"))
    settled = slots(ranked).select(
        "engagement_id", F.col("scope").alias("new_scope"), slot_text("slots").alias("new_slots"))
    compared = engagements.join(settled, "engagement_id", "left")

    def change(field, old, new):
        return compared.filter(~F.col(old).eqNullSafe(F.col(new))).select(
            "engagement_id", F.lit("").alias("subject"), F.lit(field).alias("field"),
            F.col(old).alias("old"), F.col(new).alias("new"))

    return (moved.unionByName(change("scope", "scope", "new_scope"))
            .unionByName(change("slots", "slots", "new_slots")))


def slot_text(column: str) -> Column:
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(
        e.key, F.lit(":"), e.value.cast("string"))), ",")


def pending(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents in force whose current version nobody has extracted."""
    read = versions.select("document_id", F.col("version").alias("current_version"),
                           F.col("status").alias("version_status"))
    return (documents.filter("standing <> 'SUPERSEDED'")
            .join(read, ["document_id", "current_version"], "left")
            .filter(F.coalesce("version_status", F.lit("missing")) != "extracted"))


def all_extracted(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Per engagement whether every document in force has been extracted."""
    waiting = pending(documents, versions).select("document_id").withColumn(
        "waiting", F.lit(True))
    return (documents.filter("standing <> 'SUPERSEDED'")
            .join(waiting, "document_id", "left")
            .groupBy("engagement_id")
            .agg(F.bool_and(F.col("waiting").isNull()).alias("all_extracted")))


def predecessors(documents: DataFrame, with_terms: DataFrame) -> DataFrame:
    """The reading each document is compared with; first uploads are absent.

    A second or later version is compared with the one before. A first version is compared with
    the newest superseded document of its type that has terms. ``with_terms`` lists
    (document_id, version) pairs.
    """
    revised = documents.filter("current_version >= 2").select(
        "document_id", "current_version", F.col("document_id").alias("previous_id"),
        (F.col("current_version") - 1).alias("previous_version"))
    older = (documents.filter("standing = 'SUPERSEDED'")
             .join(with_terms.select("document_id", F.col("version").alias("current_version"))
                   .distinct(), ["document_id", "current_version"], "left_semi"))
    # The two newest per engagement and type are enough: one of them is another document.
    newest = Window.partitionBy("engagement_id", "doc_type").orderBy(
        F.col("created_ord").desc(), F.col("document_id").desc())
    top = (older.withColumn("n", F.row_number().over(newest)).filter("n <= 2")
           .groupBy("engagement_id", "doc_type")
           .agg(F.array_sort(F.collect_list(F.struct(
               "n", F.col("document_id").alias("previous_id"),
               F.col("current_version").alias("previous_version")))).alias("top")))
    first = (documents.filter("current_version < 2")
             .join(top, ["engagement_id", "doc_type"])
             .withColumn("pick", F.get(F.filter(
                 "top", lambda t: t.previous_id != F.col("document_id")), F.lit(0)))
             .filter("pick is not null")
             .select("document_id", "current_version", "pick.previous_id",
                     "pick.previous_version"))
    return revised.unionByName(first)


# --- deletions -------------------------------------------------------------------------------
def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given documents."""
    ids = gone.select("document_id").distinct()
    return {name: df.join(ids, "document_id", "left_anti") for name, df in tables.items()}


def discard_versions(documents: DataFrame, versions: DataFrame,
                     asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, versions) after taking back uploads nobody read.

    Only versions still ``uploaded`` go, and the document rolls back to the version before.
    """
    unread = versions.filter("status = 'uploaded'").join(
        asked.select("document_id", "version").distinct(), ["document_id", "version"],
        "left_semi").select("document_id", "version")
    back = unread.groupBy("document_id").agg((F.min("version") - 1).alias("rolled_back"))
    kept = versions.join(unread, ["document_id", "version"], "left_anti")
    rolled = (documents.join(back, "document_id", "left")
              .withColumn("current_version", F.coalesce("rolled_back", "current_version"))
              .drop("rolled_back").filter("current_version > 0"))
    return rolled, kept


# --- page windows ----------------------------------------------------------------------------
PAGE_FACTS = "array<struct<page_number:int,tokens:int,starts_high:boolean,ends_low:boolean>>"
#: Where a window begins, as a place in the list of pages, and what its pages hold.
BOUND = "struct<first:int,tokens:int>"


def page_facts(pages: Column, tokens, starts_high, ends_low) -> Column:
    """Facts windowing needs per page; the three callables map a page to a column."""
    return F.transform(pages, lambda p: F.struct(
        p.page_number.cast("int").alias("page_number"), tokens(p).cast("int").alias("tokens"),
        starts_high(p).alias("starts_high"), ends_low(p).alias("ends_low")))


def table_continues(this: Column, following: Column) -> Column:
    return this.ends_low & following.starts_high


def page_windows(facts: Column, target: Column | None = None, ceiling: Column | None = None,
                 overlap: int = fv.WINDOW_OVERLAP) -> Column:
    """Windows of consecutive pages, as ARRAY<STRUCT<pages, tokens>>, folded inside one row.

    Pages are packed up to ``target`` tokens. A boundary inside a continuing table is held open up
    to ``ceiling``. A last window under half the target joins its neighbour where that fits.
    Overlap is added afterwards and never moves a boundary. Pages are an array of their document,
    so no shuffle is involved. The fold puts out where windows begin (:func:`fold_out`), and pages are
    cut out of the list once, so the work grows with the pages and not with their square.
    """
    target = F.lit(fv.WINDOW_TARGET_TOKENS) if target is None else target
    ceiling = F.lit(fv.WINDOW_MAX_TOKENS) if ceiling is None else ceiling
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("first"), F.lit(0).alias("tokens"),
                     F.lit(False).alias("ends_low"))

    def step(open_, page):
        grown = open_.tokens + page.tokens
        limit = F.when(open_.ends_low & page.starts_high, F.greatest(target, ceiling)
                       ).otherwise(target)
        cut = (open_.place > open_.first) & (grown > limit)
        after = F.struct((open_.place + 1).alias("place"),
                         F.when(cut, open_.place).otherwise(open_.first).alias("first"),
                         F.when(cut, page.tokens).otherwise(grown).alias("tokens"),
                         page.ends_low.alias("ends_low"))
        closed = F.array(F.struct(open_.first.alias("first"), open_.tokens.alias("tokens")))
        return after, F.when(cut, closed).otherwise(F.array().cast(f"array<{BOUND}>"))

    def windows(pages):
        def all_bounds(folded):
            last = F.array(F.struct(folded.carry.first.alias("first"), folded.carry.tokens.alias("tokens")))
            return F.when(folded.carry.place > 0, F.concat(folded.out, last)).otherwise(folded.out)

        bounds = let(fold_out(pages, start, step, BOUND), all_bounds)
        kept = let(bounds, lambda every: _without_stub(every, target, ceiling))
        numbers = F.transform(pages, lambda p: p.page_number)
        return let(kept, lambda every: let(numbers, lambda n: _pages_of(every, n, overlap)))

    return let(F.coalesce(facts, F.array().cast(PAGE_FACTS)), windows)


def _without_stub(bounds: Column, target: Column, ceiling: Column) -> Column:
    """The last window folded into the one before when it is thin and the sum still fits."""
    last, before = F.get(bounds, F.size(bounds) - 1), F.get(bounds, F.size(bounds) - 2)
    thin = ((F.size(bounds) > 1) & (last.tokens < target * 0.5)
            & (last.tokens + before.tokens <= ceiling))
    joined = F.concat(
        F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 2, F.lit(0))),
        F.array(F.struct(before["first"].alias("first"), (before.tokens + last.tokens).alias("tokens"))))
    return F.when(thin, joined).otherwise(bounds)


def _pages_of(bounds: Column, numbers: Column, overlap: int) -> Column:
    """Windows with their page numbers, each led by the last ``overlap`` pages of the one before."""
    def window(bound, i):
        end = F.coalesce(F.get(bounds, i + 1)["first"], F.size(numbers))
        lead = F.greatest(bound["first"] - max(overlap, 0), F.coalesce(F.get(bounds, i - 1)["first"], F.lit(0)))
        begin = F.when(i == 0, bound["first"]).otherwise(lead)
        return F.struct(F.slice(numbers, begin + 1, end - begin).alias("pages"), bound["tokens"].alias("tokens"))

    return F.transform(bounds, window)


def call_plan(documents: DataFrame, output_cap: Column,
              fill: float = fv.PLANNING_FILL) -> DataFrame:
    """One row per (document, question, window) to ask, sized so each answer fits the cap.

    ``documents`` has document_id and facts (see :func:`page_facts`). Facts of the whole document
    are asked once, in the first window of the pricing question.
    """
    total = F.aggregate("facts", F.lit(0), lambda acc, p: acc + p.tokens)
    expected = F.col("per_page") * F.greatest(F.size("facts"), F.lit(1))
    room = F.floor(output_cap * fill)
    need = F.greatest(F.lit(1), F.ceil(expected / room))
    target = F.greatest(F.lit(1), F.floor(F.col("total") / F.col("need"))).cast("int")
    one = F.array(F.struct(F.transform("facts", lambda p: p.page_number).alias("pages"),
                           F.col("total").alias("tokens")))
    # The six questions are a fixed array in every document's row: no join, no shuffle.
    questions = F.array(*[
        F.struct(F.lit(q).alias("question"), F.lit(n).alias("per_page"))
        for q, n in fv.OUTPUT_TOKENS_PER_PAGE.items()])
    asked = (documents.withColumn("total", total).withColumn("q", F.explode(questions))
             .select("*", "q.*").drop("q").withColumn("need", need)
             .withColumn("target", target))
    windows = F.when(F.col("need") == 1, one).otherwise(page_windows(
        F.col("facts"), F.col("target"), F.floor(F.col("target") * 1.5).cast("int")))
    return (asked.select("document_id", "question",
                         F.posexplode(windows).alias("window_index", "w"))
            .select("document_id", "question", "window_index",
                    F.col("w.pages").alias("pages"),
                    ((F.col("question") == "pricing") & (F.col("window_index") == 0))
                    .alias("asks_document_facts")))


def retry_plan(calls: DataFrame) -> DataFrame:
    """Truncated calls over two or more pages, asked again over each half."""
    half = F.floor(F.size("pages") / 2).cast("int")
    halves = F.array(F.slice("pages", F.lit(1), half),
                     F.slice("pages", half + 1, F.size("pages") - half))
    return (calls.filter(F.col("truncated") & (F.size("pages") >= 2))
            .select("document_id", "question", "window_index",
                    F.posexplode(halves).alias("half", "pages"))
            .withColumn("retry_index", 1000 * (F.col("window_index") + 1) + F.col("half")))
