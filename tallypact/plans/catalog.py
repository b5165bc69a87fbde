"""Resolving contract wording against the service catalog, and deriving that catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions.folds import fold_out
from tallypact.functions.text import clean_heading, normalise_name, slugify
from tallypact.operators.similarity import close_pairs, pruning_floor
from tallypact.session import cut_lineage


def _spellings(entries: DataFrame) -> DataFrame:
    """(scope, entry_id, text, rung, place) rows of names and aliases in catalog order.

    ``entries`` has scope, entry_id, position, name and aliases.
    """
    name = entries.select("scope", "entry_id", F.trim("name").alias("text"),
                          F.lit("exact").alias("rung"),
                          F.struct(F.col("position"), F.lit(0).alias("n")).alias("place"))
    alias = (entries.select("scope", "entry_id", "position", F.posexplode("aliases"))
             .select("scope", "entry_id", F.trim("col").alias("text"),
                     F.lit("alias").alias("rung"),
                     F.struct(F.col("position"), (F.col("pos") + 1).alias("n")).alias("place")))
    return name.unionByName(alias)


def _first_entry(spellings: DataFrame, text: str) -> DataFrame:
    """For each spelling the first entry that has it, so a lookup finds one row."""
    return spellings.groupBy("scope", text).agg(F.min_by("entry_id", "place").alias("hit"))


def equal_rungs(names: DataFrame, spellings: DataFrame) -> DataFrame:
    """Names placed by an equal spelling: exact, alias, or normalised, in that order.

    ``names`` has scope, raw, text and key; names no rung places keep a NULL entry and kind.
    """
    exact = _first_entry(spellings.filter("rung = 'exact'"), "text").withColumnRenamed(
        "hit", "by_name")
    alias = _first_entry(spellings.filter("rung = 'alias'"), "text").withColumnRenamed(
        "hit", "by_alias")
    by_key = _first_entry(spellings, "key").filter("key <> ''").withColumnRenamed(
        "hit", "by_key")
    kind = (F.when(F.col("by_name").isNotNull(), "exact")
            .when(F.col("by_alias").isNotNull(), "alias")
            .when(F.col("by_key").isNotNull(), "normalised"))
    return (names.join(exact, ["scope", "text"], "left").join(alias, ["scope", "text"], "left")
            .join(by_key, ["scope", "key"], "left")
            .select("scope", "raw", "key", F.coalesce("by_name", "by_alias", "by_key")
                    .alias("entry_id"), kind.alias("kind")))


def distinct_names(names: DataFrame) -> DataFrame:
    return (names.select("scope", "raw").distinct().withColumn("text", F.trim("raw"))
            .withColumn("key", normalise_name(F.col("text"))))


def keyed_spellings(entries: DataFrame) -> DataFrame:
    return _spellings(entries).withColumn("key", normalise_name(F.col("text")))


def resolve_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (scope, raw) names with entry_id and match kind.

    The ladder is exact, alias, normalised, fuzzy, unmatched. Only the names no equal spelling
    placed go on to similarity. The distinct names and the catalog's spellings are read several
    times, so both are written out once.
    """
    spellings = cut_lineage(keyed_spellings(entries), "spellings")
    placed = cut_lineage(equal_rungs(distinct_names(names), spellings), "placed")
    left_over = placed.filter("entry_id is null and key <> ''").select("scope", "key").distinct()
    if left_over.isEmpty():
        return placed.select("scope", "raw", "entry_id",
                             F.coalesce("kind", F.lit("unmatched")).alias("kind"))
    close = _closest(left_over, _first_entry(spellings, "key"))
    return (placed.join(close, ["scope", "key"], "left")
            .select("scope", "raw", F.coalesce("entry_id", "close_id").alias("entry_id"),
                    F.coalesce("kind", F.when(F.col("close_id").isNotNull(), "fuzzy"),
                               F.lit("unmatched")).alias("kind")))


def _closest(names: DataFrame, keys: DataFrame) -> DataFrame:
    """Names with the entry whose key is closest, when it is close enough and clearly ahead.

    Competitors are keys: two close aliases of one entry block each other.
    """
    floor = pruning_floor(fv.FUZZY_FLOOR, fv.FUZZY_MARGIN)
    pairs = close_pairs(names, keys.select("scope", "key"), floor)
    # Only catalog keys within reach of the name are listed, two of which matter.
    best_two = F.slice(F.sort_array(F.collect_list(F.struct("score", "right_key")), False), 1, 2)
    ranked = pairs.groupBy("scope", "left_key").agg(best_two.alias("top"))
    first = F.col("top")[0]
    second = F.coalesce(F.get("top", F.lit(1)).score, F.lit(0.0))
    clear = (first.score >= fv.FUZZY_FLOOR) & (first.score - second >= fv.FUZZY_MARGIN)
    return (ranked.filter(clear)
            .select("scope", F.col("left_key").alias("key"), first.right_key.alias("found"))
            .join(keys.select("scope", F.col("key").alias("found"), "hit"), ["scope", "found"])
            .select("scope", "key", F.col("hit").alias("close_id")))


def resolve(wordings: DataFrame, programs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (program_raw, item_raw) wordings with program, item and the weaker match kind.

    Items are looked up within the resolved program only. ``programs`` has program_id, position,
    name, aliases; ``items`` has program_id, item_id, position, name, aliases.
    """
    wordings = cut_lineage(wordings.select("program_raw", "item_raw").distinct(), "wordings")
    program_entries = programs.select(
        F.lit("").alias("scope"), F.col("program_id").alias("entry_id"), "position", "name",
        "aliases")
    blank = F.coalesce(F.trim("program_raw"), F.lit("")) == ""
    found = resolve_names(
        wordings.filter(~blank).select(F.lit("").alias("scope"),
                                       F.col("program_raw").alias("raw")), program_entries)
    found = found.select(F.col("raw").alias("program_raw"),
                         F.col("entry_id").alias("program_id"),
                         F.col("kind").alias("program_kind"))
    with_program = wordings.join(found, "program_raw", "left")
    named = with_program.filter(F.col("program_id").isNotNull() & (
        F.coalesce(F.trim("item_raw"), F.lit("")) != ""))
    item_entries = items.select(F.col("program_id").alias("scope"),
                                F.col("item_id").alias("entry_id"), "position", "name",
                                "aliases")
    found_items = resolve_names(
        named.select(F.col("program_id").alias("scope"), F.col("item_raw").alias("raw")),
        item_entries).select(
        F.col("scope").alias("program_id"), F.col("raw").alias("item_raw"),
        F.col("entry_id").alias("item_id"), F.col("kind").alias("item_kind"))
    rank = F.array(*[F.lit(k) for k in fv.MATCH_KINDS])
    weaker = F.when(F.col("item_id").isNull(), F.col("program_kind")).otherwise(F.element_at(
        rank, F.greatest(F.array_position(rank, F.col("program_kind")),
                         F.array_position(rank, F.col("item_kind"))).cast("int")))
    return (with_program.join(found_items, ["program_id", "item_raw"], "left")
            .select("program_raw", "item_raw", "program_id", "item_id",
                    F.coalesce(weaker, F.lit("unmatched")).alias("kind")))


def unplaced(sightings: DataFrame, programs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose ``raw`` names no program of the catalog, by the whole ladder of :func:`resolve`."""
    names = sightings.filter("raw is not null").select(F.col("raw").alias("program_raw"), F.lit(None).cast("string").alias("item_raw"))
    lost = resolve(names, programs, items).filter("program_id is null").select(F.col("program_raw").alias("raw"))
    return sightings.join(lost, "raw", "left_semi")


def unmatched_queue(sightings: DataFrame, examples: int = 5) -> DataFrame:
    """Names the catalog could not place: count, first and last seen, a few examples.

    ``sightings`` has raw, example and seen_at. Duplicates collapse before anything is ranked, and
    the ranking keeps only its first rows per key in every task.
    """
    keyed = sightings.withColumn("normalised", normalise_name(F.col("raw")))
    counts = keyed.groupBy("normalised").agg(
        F.count("*").alias("seen"), F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"), F.min_by("raw", F.struct("seen_at", "raw"))
        .alias("raw"))
    per = Window.partitionBy("normalised").orderBy("first_at", "example")
    few = (keyed.groupBy("normalised", "example").agg(F.min("seen_at").alias("first_at"))
           .withColumn("n", F.row_number().over(per)).filter(F.col("n") <= examples)
           .groupBy("normalised")
           .agg(F.array_sort(F.collect_list(F.struct("n", "example"))).alias("e"))
           .select("normalised", F.col("e.example").alias("examples")))
    return counts.join(few, "normalised")


QUEUE = ("normalised string, raw string, seen long, first_seen long, last_seen long, "
         "examples array<struct<at: long, example: string>>")


def queue_of(sightings: DataFrame, examples: int = 5) -> DataFrame:
    """Sightings (raw, example, seen_at as a number) as rows of ``QUEUE``, which :func:`merge_queue` adds up."""
    found = unmatched_queue(sightings, examples)
    at = F.transform("examples", lambda e: F.struct(F.col("first_seen").cast("long").alias("at"), e.alias("example")))
    return found.select("normalised", "raw", F.col("seen").cast("long").alias("seen"), F.col("first_seen").cast("long").alias("first_seen"),
                        F.col("last_seen").cast("long").alias("last_seen"), at.alias("examples"))


def merge_queue(stored: DataFrame, fresh: DataFrame, examples: int = 5) -> DataFrame:
    """The queue after more sightings: counts add up, the first few different examples stay."""
    new = fresh.select("normalised", *[F.col(c).alias(f"n_{c}") for c in fresh.columns if c != "normalised"])
    both = stored.join(new, "normalised", "full_outer")
    known = F.transform("examples", lambda e: e.example)
    more = F.filter("n_examples", lambda e: ~F.coalesce(F.array_contains(known, e.example), F.lit(False)))
    none = F.array().cast("array<struct<at: long, example: string>>")
    kept = F.slice(F.concat(F.coalesce("examples", none), F.coalesce(more, none)), 1, examples)
    zero = F.lit(0)
    return both.select("normalised", F.coalesce("raw", "n_raw").alias("raw"),
                       (F.coalesce("seen", zero) + F.coalesce("n_seen", zero)).alias("seen"),
                       F.least("first_seen", "n_first_seen").alias("first_seen"),
                       F.greatest("last_seen", "n_last_seen").alias("last_seen"), kept.alias("examples"))


# --- derivation ------------------------------------------------------------------------------
def scan_headings(tables: DataFrame) -> DataFrame:
    """(contract, program, item) pairs of pricing tables; a heading holds until the next one.

    ``tables`` has contract and rows (ARRAY of cell arrays). A table is one row, so the scan is a
    fold inside that row. ``item`` is NULL on the heading's own row.
    """
    cells = F.transform("rows", lambda row: F.transform(
        row, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    marked = F.transform(cells, lambda row: F.struct(
        F.get(F.filter(F.transform(row, clean_heading), lambda h: h.isNotNull()), F.lit(0))
        .alias("heading"),
        F.coalesce(F.get(row, F.lit(0)), F.lit("")).alias("label")))
    pair = "struct<program:string,item:string>"

    def step(current, row):
        label = row.label
        usable = ((current != "") & (F.length(label) > 4) & (F.length(label) < 80)
                  & ~(label.rlike("[A-Z]") & (label == F.upper(label))))
        found = F.when(row.heading.isNotNull(), F.array(F.struct(
            row.heading.alias("program"), F.lit(None).cast("string").alias("item"))))
        found = found.when(usable, F.array(F.struct(current.alias("program"), label.alias("item"))))
        return F.coalesce(row.heading, current), found.otherwise(F.array().cast(f"array<{pair}>"))

    return tables.select("contract", F.inline(fold_out(marked, F.lit(""), step, pair).out))


def cluster_names(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Surface forms grouped by key; the one in most contracts, then the shortest, is the name.

    ``counts`` has name and contracts, and the columns of ``by`` that keep groups apart.
    """
    by = by or []
    keyed = counts.withColumn("name_key", normalise_name(F.col("name"))).filter("name_key <> ''")
    best = F.struct(F.col("contracts"), -F.length("name"), F.col("name"))
    return (keyed.groupBy(*by, "name_key")
            .agg(F.max_by("name", best).alias("name"), F.max("contracts").alias("contracts"),
                 F.collect_set("name").alias("names"))
            .select(*by, slugify(F.col("name")).alias("entry_id"), "name_key", "name",
                    F.array_sort(F.array_except("names", F.array("name"))).alias("aliases"),
                    "contracts"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Rules (kind, spelling, target) with the keys they are looked up by."""
    return rules.withColumn("rule_key", normalise_name(F.col("spelling")))


def derive_catalog(pairs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(programs, items) from (contract, program, item) pairs and editorial rules.

    Rules have kind (drop, merge, category), spelling and target. Counts are of distinct
    contracts, so one contract repeating a name cannot outvote the others.
    """
    keyed = _rule_keys(rules)
    drops = keyed.filter("kind = 'drop'").select(F.col("rule_key").alias("name_key")).distinct()
    merges = keyed.filter("kind = 'merge'").groupBy(F.col("rule_key").alias("name_key")).agg(
        F.max("target").alias("target"))
    seen = (pairs.select("contract", "program", "item").distinct()
            .withColumn("name_key", normalise_name(F.col("program")))
            .join(drops, "name_key", "left_anti").join(merges, "name_key", "left")
            .withColumn("name", F.coalesce("target", "program")))
    # A program's count adds up its spellings, each counted once per contract.
    counts = (seen.select("contract", "program", "name").distinct()
              .groupBy("name").agg(F.count("*").alias("contracts")))
    unseen = merges.select(F.col("target").alias("name"), F.lit(0).cast("bigint")
                           .alias("contracts")).distinct()
    counts = (counts.unionByName(unseen).groupBy("name")
              .agg(F.max("contracts").alias("contracts")))
    programs = cluster_names(counts)
    categories = keyed.filter("kind = 'category'").groupBy(
        F.col("rule_key").alias("name_key")).agg(F.max("target").alias("category"))
    spelled = (keyed.filter("kind = 'merge'").select(
        normalise_name(F.col("target")).alias("name_key"), F.col("spelling").alias("extra"))
        .unionByName(seen.filter("target is not null").select(
            normalise_name(F.col("target")).alias("name_key"), F.col("program").alias("extra")))
        .groupBy("name_key").agg(F.collect_set("extra").alias("extra")))
    programs = (programs.join(spelled, "name_key", "left").join(categories, "name_key", "left")
                .withColumn("aliases", F.array_sort(F.array_except(F.array_distinct(F.concat(
                    "aliases", F.coalesce("extra", F.array().cast("array<string>")))),
                    F.array("name")))).drop("extra"))
    item_counts = (seen.filter("item is not null")
                   .select("contract", "program", "item",
                           normalise_name(F.col("name")).alias("program_key")).distinct()
                   .groupBy("program_key", F.col("item").alias("name"))
                   .agg(F.count("*").alias("contracts")))
    items = cluster_names(item_counts, ["program_key"])
    return programs, items


def recurate(programs: DataFrame, items: DataFrame,
             rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Editorial rules applied to a catalog that exists already; running it twice changes nothing.

    ``programs`` has program_id, name, aliases, category, contracts; ``items`` has program_id,
    item_id, name.
    """
    keyed = _rule_keys(rules)
    drops = keyed.filter("kind = 'drop'").select(F.col("rule_key").alias("name_key")).distinct()
    merges = (keyed.filter("kind = 'merge'")
              .select(F.col("rule_key").alias("name_key"), F.col("spelling").alias("rule_name"),
                      normalise_name(F.col("target")).alias("into_key")))
    categories = keyed.filter("kind = 'category'").groupBy(
        F.col("rule_key").alias("name_key")).agg(F.max("target").alias("new_category"))
    known = programs.withColumn("name_key", normalise_name(F.col("name")))
    targets = known.groupBy(F.col("name_key").alias("into_key")).agg(
        F.min("program_id").alias("into_id"))
    moved = (known.join(drops, "name_key", "left_anti").join(merges, "name_key")
             .join(targets, "into_key").filter("into_id <> program_id"))
    move = moved.select("program_id", "into_id").distinct()
    gained = (moved.groupBy("into_id").agg(
        F.collect_set("name").alias("moved_names"), F.sum("contracts").alias("moved_contracts")))
    spelled = (merges.join(targets, "into_key").groupBy("into_id")
               .agg(F.collect_set("rule_name").alias("spellings")))
    none = F.array().cast("array<string>")
    kept = (known.join(drops, "name_key", "left_anti").join(move, "program_id", "left_anti")
            .join(gained, F.col("program_id") == F.col("into_id"), "left").drop("into_id")
            .join(spelled, F.col("program_id") == F.col("into_id"), "left").drop("into_id")
            .join(categories, "name_key", "left"))
    kept = kept.select(
        "program_id", "name",
        F.array_sort(F.array_except(F.array_distinct(F.concat(
            "aliases", F.coalesce("moved_names", none), F.coalesce("spellings", none))),
            F.array("name"))).alias("aliases"),
        F.coalesce("new_category", "category").alias("category"),
        (F.col("contracts") + F.coalesce("moved_contracts", F.lit(0))).alias("contracts"))
    owned = (items.join(move, "program_id", "left")
             .withColumn("program_id", F.coalesce("into_id", "program_id")).drop("into_id")
             .join(kept.select("program_id"), "program_id", "left_semi"))
    deduped = owned.groupBy("program_id", "item_id").agg(F.min("name").alias("name"))
    return kept, deduped


def adoption(programs: DataFrame, items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every program with its item count and the engagements that use it."""
    counts = items.groupBy("program_id").agg(F.count("*").alias("item_count"))
    uses = coverage.groupBy("program_id").agg(
        F.count_distinct("engagement_id").alias("engagement_count"))
    return (programs.join(counts, "program_id", "left").join(uses, "program_id", "left")
            .na.fill(0, ["item_count", "engagement_count"]))


def adoption_order() -> list[Column]:
    return [F.col("engagement_count").desc(), F.col("contract_count").desc(), F.col("name")]
