"""Extraction quality and cost: scoring against expected records, run telemetry, bake-offs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import calls as call_fn
from tallypact.functions.billing import rounded_ratio
from tallypact.functions.text import key_words, scoring_text
from tallypact.operators.matching import in_order_matches
from tallypact.session import cut_lineage

GROUP = ["run_id", "info_type"]
EXACT = 2.0
#: Rows of a run that are compared inside one row or join group; larger runs meet on words.
SMALL = 256


def keyed(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records with their exact key and their set of significant words over ``fields``."""
    return (records.withColumn("exact_key", F.concat_ws(
        "\u001f", *[scoring_text(F.col(f)) for f in fields]))
        .withColumn("words", F.array_distinct(F.flatten(F.array(
            *[key_words(F.col(f)) for f in fields])))))


def _large(sides: list[DataFrame], by: list[str], odd: str | None = None) -> DataFrame:
    """Groups with more than ``SMALL`` rows, or with a row that is ``odd``; written, so joins know how few they are."""
    keys = functools.reduce(DataFrame.unionByName, [
        side.select(*by, F.expr(odd or "false").alias("odd")) for side in sides])
    return cut_lineage(keys.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or("odd").alias("odd"))
                       .filter((F.col("n") > SMALL) | F.col("odd")).select(*by), "large")


def _among(rows: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    same = functools.reduce(lambda a, b: a & b, [rows[c].eqNullSafe(groups[c]) for c in by])
    return rows.join(groups, same, how)


def candidate_scores(expected: DataFrame, got: DataFrame, floor: float,
                     by: list[str]) -> DataFrame:
    """(chooser, candidate, score) where enough of the expected words are shared, with the share as ``overlap``.

    Rows of a small group meet directly, so each side is shuffled once; rows of a large one meet on words.
    """
    large = _large([expected, got], by)
    found = _scored(_among(expected, large, by, "left_anti"), _among(got, large, by, "left_anti"), None, floor, by)
    if large.isEmpty():
        return found
    many = _among(expected, large, by, "left_semi"), _among(got, large, by, "left_semi")
    return found.unionByName(_scored(*many, _pairs(*many, floor, by), floor, by))


def _scored(expected: DataFrame, got: DataFrame, pairs: DataFrame | None, floor: float, by: list[str]) -> DataFrame:
    """Scores of all rows of a group, or of ``pairs``."""
    want = expected.select(*by, F.col("record_no").alias("chooser"), "words", "exact_key")
    have = got.select(*by, F.col("record_no").alias("candidate"),
                      F.col("words").alias("got_words"), F.col("exact_key").alias("got_key"))
    both = (want.filter("chooser is not null").join(have.filter("candidate is not null"), by) if pairs is None else
            pairs.join(want, [*by, "chooser"]).join(have, [*by, "candidate"]))
    same = F.col("exact_key") == F.col("got_key")
    overlap = F.try_divide(F.size(F.array_intersect("words", "got_words")), F.size("words"))
    return (both.select(*by, "chooser", "candidate", same.alias("same"), overlap.alias("overlap"))
            .withColumn("score", F.when(F.col("same"), EXACT).otherwise(F.col("overlap")))
            .filter(F.col("score") >= floor)
            .select(*by, "chooser", "candidate", "score", "same", "overlap"))


def _pairs(expected: DataFrame, got: DataFrame, floor: float, by: list[str]) -> DataFrame:
    """(chooser, candidate) that may share enough words or have equal keys.

    Candidates come from an equi join on words, counted per pair. Only the rarest expected words
    are looked up: a record that shares a share ``floor`` of n words shares at least one of any
    n - ceil(floor n) + 1 of them.
    """
    want = expected.select(*by, F.col("record_no").alias("chooser"), "words", "exact_key",
                           F.size("words").alias("wanted"))
    have = got.select(*by, F.col("record_no").alias("candidate"),
                      F.col("words").alias("got_words"), F.col("exact_key").alias("got_key"))
    lookup = have.select(*by, "candidate", F.explode("got_words").alias("word"))
    uses = lookup.groupBy("word").agg(F.count("*").alias("uses"))
    ranked = (want.filter("wanted > 0")
              .select(*by, "chooser", "wanted", F.explode("words").alias("word"))
              .join(uses, "word")
              .groupBy(*by, "chooser", "wanted")
              .agg(F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("found")))
    # An expected record has a handful of words; words nobody has are already gone.
    absent = F.col("wanted") - F.size("found")
    needed = F.greatest(F.lit(1), F.ceil(F.col("wanted") * floor - 1e-9))
    allowed = F.col("wanted") - needed + 1 - absent
    rare = (ranked.filter(allowed > 0)
            .select(*by, "chooser", F.explode(F.slice(
                "found", F.lit(1), allowed.cast("int")).word).alias("word")))
    pairs = rare.join(lookup, [*by, "word"]).select(*by, "chooser", "candidate")
    # Equal keys match whether they have significant words or not.
    equal = want.join(have, (want["exact_key"] == have["got_key"]) & functools.reduce(
        lambda a, b: a & b, [want[c] == have[c] for c in by])).select(
            *[want[c] for c in by], "chooser", "candidate")
    return pairs.unionByName(equal).distinct()


def match_records(expected: DataFrame, got: DataFrame) -> DataFrame:
    """One-to-one matches per run and type: an equal key first, else the best word overlap.

    Expected records choose in order of ``record_no``; equal scores go to the earlier record.
    """
    edges = candidate_scores(expected, got, 0.5, GROUP)
    return in_order_matches(edges, GROUP)


def score_runs(expected: DataFrame, got: DataFrame, everything: DataFrame) -> DataFrame:
    """Per run and type: expected, found in type, found elsewhere, missed, extra, recall.

    ``everything`` holds every record of the run with all its words, for content that was filed
    under another type: a share of 0.6 of at least two words counts as covered. A small run is scored
    inside its row, so every side is shuffled once; large ones, and rows without a run or type, are joined.
    """
    by = ["run_id"]
    large = _large([expected, got, everything], by, "run_id is null or info_type is null or record_no is null")
    sides = (expected, got, everything)
    rows = _small_runs(*[_among(side, large, by, "left_anti") for side in sides])
    if not large.isEmpty():
        rows = rows.unionByName(_large_runs(*[_among(side, large, by, "left_semi") for side in sides]))
    covered = F.col("found") + F.col("elsewhere")
    one = F.lit(1.0)
    return rows.select(
        *GROUP, "expected", "got", "found", "elsewhere",
        (F.col("expected") - covered).alias("missed"),
        (F.col("got") - F.col("found")).alias("extra"),
        F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(one)
        .alias("recall"),
        F.when(F.col("expected") > 0, covered / F.col("expected")).otherwise(one)
        .alias("coverage"))


def _small_runs(expected: DataFrame, got: DataFrame, everything: DataFrame) -> DataFrame:
    """Counts per run and type; the records of a run are lists in its row."""

    def listed(side, name):
        record = F.struct("record_no", "info_type", "words", "exact_key")
        return (side.select("run_id", record.alias("record")).repartition("run_id").groupBy("run_id")
                .agg(F.collect_list("record").alias("records")).withColumnRenamed("records", name))

    def share(a, b):
        return F.try_divide(F.size(F.array_intersect(a["words"], b["words"])), F.size(a["words"]))

    def edge(a, b):
        score = F.when(a["exact_key"] == b["exact_key"], EXACT).otherwise(share(a, b))
        return F.struct(a["info_type"].alias("type"), a["record_no"].alias("chooser"), (-score).alias("s"),
                        b["record_no"].alias("candidate"))

    def edges_of(a):
        same_type = F.filter("got", lambda b: b["info_type"] == a["info_type"])
        return F.filter(F.transform(same_type, lambda b: edge(a, b)), lambda e: e["s"] <= -0.5)

    def taken(e, m):
        return (m["type"] == e["type"]) & ((m["chooser"] == e["chooser"]) | (m["candidate"] == e["candidate"]))

    # Choosers in order, each with its best candidate first: an edge is taken if both its ends are free.
    match = "array<struct<type:string,chooser:{0},candidate:{1}>>".format(
        expected.schema["record_no"].dataType.simpleString(), got.schema["record_no"].dataType.simpleString())
    found = F.aggregate("edges", F.array().cast(match), lambda done, e: F.when(
        F.exists(done, lambda m: taken(e, m)), done).otherwise(F.array_append(done, F.struct(
            e["type"].alias("type"), e["chooser"].alias("chooser"), e["candidate"].alias("candidate")))))

    def missed(a):
        return (F.size(a["words"]) >= 2) & ~F.exists("found", lambda m: (
            m["type"] == a["info_type"]) & (m["chooser"] == a["record_no"]))

    def elsewhere(a):
        return missed(a) & F.exists("everything", lambda b: F.coalesce(share(a, b) >= 0.6, F.lit(False)))

    none = F.array().cast("array<struct<record_no:{0},info_type:string,words:array<string>,exact_key:string>>".format(
        expected.schema["record_no"].dataType.simpleString()))
    runs = (listed(expected, "expected").join(listed(everything, "everything"), "run_id", "left")
            .join(listed(got, "got"), "run_id", "full_outer")
            .withColumns({c: F.coalesce(c, none) for c in ("expected", "got", "everything")})
            .withColumn("edges", F.array_sort(F.flatten(F.transform("expected", edges_of))))
            .withColumn("found", found)
            .withColumn("elsewhere", F.array_distinct(F.transform(
                F.filter("expected", elsewhere), lambda a: F.struct(a["info_type"].alias("type"), a["record_no"]))))
            .withColumn("info_type", F.explode(F.array_distinct(F.concat("expected.info_type", "got.info_type")))))

    def of_type(name, field):
        return F.size(F.filter(name, lambda x: x[field] == F.col("info_type"))).cast("long").alias(name)

    return runs.select(*GROUP, of_type("expected", "info_type"), of_type("got", "info_type"), of_type("found", "type"),
                       of_type("elsewhere", "type"))


def _large_runs(expected: DataFrame, got: DataFrame, everything: DataFrame) -> DataFrame:
    """Counts per run and type, by joins of records."""
    found = cut_lineage(match_records(expected, got), "matches")
    left = expected.join(found.select(*GROUP, F.col("chooser").alias("record_no")),
                         [*GROUP, "record_no"], "left_anti").filter(F.size("words") >= 2)
    anywhere = left.withColumn("record_no", F.struct(
        F.col("info_type"), F.col("record_no")))
    other = everything.withColumn("exact_key", F.lit("\u0000"))
    elsewhere = (candidate_scores(anywhere, other, 0.6, ["run_id"])
                 .select("run_id", "chooser").distinct()
                 .select("run_id", F.col("chooser.info_type").alias("info_type"))
                 .groupBy(*GROUP).agg(F.count("*").alias("elsewhere")))
    counts = expected.groupBy(*GROUP).agg(F.count("*").alias("expected"))
    read = got.groupBy(*GROUP).agg(F.count("*").alias("got"))
    hits = found.groupBy(*GROUP).agg(F.count("*").alias("found"))
    return (counts.join(read, GROUP, "full_outer").join(hits, GROUP, "left")
            .join(elsewhere, GROUP, "left").na.fill(0))


def amount_agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How often the amounts of matched records agree to half a cent."""
    both = F.col("expected_amount").isNotNull() & F.col("got_amount").isNotNull()
    agree = both & (F.abs(F.col("expected_amount") - F.col("got_amount")) < 0.005)
    return (pairs.groupBy(*by).agg(F.count_if(both).alias("compared"),
                                   F.count_if(agree).alias("agreeing"))
            .withColumn("rate", F.when(F.col("compared") > 0,
                                       F.col("agreeing") / F.col("compared")).otherwise(1.0)))


def programs_matched(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Expected program names that were found: equal, or the words of one within the other's.

    Both inputs have run_id and program, which may repeat. The names of a small run are lists in its row; names of larger
    runs, and of none, are joined.
    """
    by = ["run_id"]
    large = _large([expected, got], by, "run_id is null")
    want, have = (_among(side.select("run_id", "program"), large, by, "left_anti") for side in (expected, got))

    def listed(side, name):
        return side.repartition("run_id").groupBy("run_id").agg(F.collect_set(F.struct("program")).alias(name))

    def worded_list(name):
        return F.transform(name, lambda x: F.struct(x["program"].alias("program"), key_words(x["program"]).alias("words")))

    def within(a, b):
        return F.size(F.array_except(a["words"], b["words"])) == 0

    small = (listed(want, "want").join(listed(have, "have"), "run_id")
             .select("run_id", worded_list("want").alias("want"), worded_list("have").alias("have"))
             .select("run_id", F.explode(F.filter("want", lambda a: F.exists(
                 "have", lambda b: within(a, b) | within(b, a)))).alias("hit"))
             .select("run_id", F.col("hit.program").alias("program")))
    if large.isEmpty():
        return small
    return small.unionByName(_programs_of_large(*[
        _among(side.select("run_id", "program"), large, by, "left_semi").distinct() for side in (expected, got)]))


def _programs_of_large(expected: DataFrame, got: DataFrame) -> DataFrame:
    """The same by joins; both inputs are distinct.

    A name can only be within another that has its rarest word, so a pair
    meets on the rarest word of one of its names; a word that all names share brings no pair together unless it is all that
    a name has. A name without significant words is within every name, so any name of the run matches it.
    """
    def worded(df, name):
        return df.select("run_id", F.col("program").alias(name),
                         key_words(F.col("program")).alias(f"{name}_words"))

    want, have = worded(expected, "want"), worded(got, "have")
    each_want = want.withColumn("w", F.explode("want_words"))
    each_have = have.withColumn("w", F.explode("have_words"))
    uses = (each_want.select("run_id", "w").unionByName(each_have.select("run_id", "w"))
            .groupBy("run_id", "w").agg(F.count("*").alias("uses")))

    def rarest(each, name):
        return (each.join(uses, ["run_id", "w"]).groupBy("run_id", name)
                .agg(F.min(F.struct("uses", "w")).alias("r"), F.first(f"{name}_words").alias(f"{name}_words"))
                .select("run_id", F.col("r.w").alias("w"), name, f"{name}_words"))

    columns = ["run_id", "want", "want_words", "have", "have_words"]
    pairs = (rarest(each_want, "want").join(each_have, ["run_id", "w"]).select(*columns)
             .unionByName(rarest(each_have, "have").join(each_want, ["run_id", "w"]).select(*columns)))
    inside = ((F.size(F.array_except("want_words", "have_words")) == 0)
              | (F.size(F.array_except("have_words", "want_words")) == 0))
    hit = pairs.filter(inside).select("run_id", "want")
    bare = F.size("want_words") == 0
    wordless = want.filter(bare).join(have, "run_id", "left_semi").select("run_id", "want")
    open_runs = have.filter(F.size("have_words") == 0).select("run_id").distinct()
    by_empty = want.join(open_runs, "run_id", "left_semi").select("run_id", "want")
    return hit.unionByName(wordless).unionByName(by_empty).distinct().withColumnRenamed(
        "want", "program")


# --- telemetry -------------------------------------------------------------------------------
def priced_calls(calls: DataFrame) -> DataFrame:
    """Calls with cost, uncached cost and whether they came back cut off.

    ``calls`` has model, the four token counts, stop_reason, overflowed and salvaged.
    """
    tokens = [F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens",
                                 "cache_write_tokens")]
    cap = F.coalesce(F.col("price.max_output_tokens"), F.lit(fv.DEFAULT_OUTPUT_CAP))
    return (calls.withColumn("price", call_fn.price_of(F.col("model")))
            .withColumn("cost_usd", call_fn.call_cost_usd(F.col("price"), *tokens))
            .withColumn("uncached_cost_usd", call_fn.uncached_cost_usd(F.col("price"), *tokens))
            .withColumn("truncated", call_fn.truncated(
                F.col("overflowed"), F.col("salvaged"), F.col("stop_reason"),
                F.col("output_tokens"), cap)))


def run_telemetry(priced: DataFrame) -> DataFrame:
    """Tokens, cost and incomplete calls per run; cost is NULL when no call has a price.

    Incomplete calls are counted here; :func:`incomplete_calls` lists them.
    """
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).alias(c)

    exact = F.sum(F.col("cost_usd").cast("decimal(20,6)")).cast("double")
    full = F.sum(F.col("uncached_cost_usd").cast("decimal(20,6)")).cast("double")
    return priced.groupBy("run_id").agg(
        F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"),
        total("cache_read_tokens"), total("cache_write_tokens"), exact.alias("cost_usd"),
        full.alias("uncached_cost_usd"), F.count_if("truncated").alias("truncated_calls"),
        F.count_if(F.col("error").isNotNull()).alias("failed_calls"))


def incomplete_calls(priced: DataFrame) -> DataFrame:
    return priced.filter(F.col("truncated") | F.col("error").isNotNull()).select(
        "run_id", "call_no", "truncated", F.col("error").isNotNull().alias("failed"))


def document_facts(metas: DataFrame, fields: list[str]) -> DataFrame:
    """Facts of a document over its calls: the latest call that states a field decides it."""
    return metas.groupBy("document_id").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("call_no"))).alias(f) for f in fields])


def bake_off(scores: DataFrame, costs: DataFrame, baseline: str) -> DataFrame:
    """Profiles side by side: recall per type, cost ratio and the distance to the baseline.

    ``scores`` has profile, info_type, found and expected; ``costs`` profile and cost_usd.
    """
    recall = scores.groupBy("profile", "info_type").agg(
        F.sum("found").alias("found"), F.sum("expected").alias("expected"))
    recall = recall.withColumn("recall", rounded_ratio(F.col("found"), F.col("expected"), 4))
    base = recall.filter(F.col("profile") == baseline).select(
        "info_type", F.col("recall").alias("base_recall"))
    price = costs.groupBy("profile").agg(F.sum(F.col("cost_usd").cast("decimal(20,6)"))
                                         .alias("cost"))
    base_price = price.filter(F.col("profile") == baseline).select(
        F.lit(1).alias("k"), F.col("cost").alias("base_cost"))
    priced = (price.withColumn("k", F.lit(1)).join(F.broadcast(base_price), "k", "left")
              .select("profile", "cost", F.try_divide(
                  F.col("base_cost").cast("double"), F.col("cost").cast("double"))
                  .alias("times_cheaper")))
    return (recall.join(base, "info_type", "left").join(priced, "profile", "left")
            .select("profile", "info_type", "found", "expected", "recall",
                    F.round(F.col("recall") - F.col("base_recall"), 4).alias("vs_baseline"),
                    F.col("cost").cast("double").alias("cost_usd"), "times_cheaper"))
