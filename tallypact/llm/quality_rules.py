"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores the measurements with one failure bit per rule. A policy is a
version and the rules it names, that is a mask; ``apply_policy`` compares bits, and ``ablation`` says for every
policy and rule how many documents the rule alone holds back, from one count per bit pattern.

Defined results: null, blank and empty texts have no words, measure zero and fail ``too_few_words``; equal rows are
measured as often as they come; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
A text's windows are compared by 64-bit hashes of their words within that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact.llm.common import SPACE

REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule name and its failure condition over the measurements; the place in the list is the bit. New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
]
#: Rules of each version of the policy.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbols", "shouting", "exclamations"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
            "n_exclamations"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _only(text: Column, others: str) -> Column:
    """Characters left when runs of ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside a window of words that comes twice or more, the first included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)),
                         lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h):
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(z):
            last = F.size(z) - 1
            hit = F.filter(F.sequence(F.lit(0), last), lambda j: (
                (j > 0) & (F.get(z, j - 1)["h"] == F.get(z, j)["h"])) | (
                (j < last) & (F.get(z, j + 1)["h"] == F.get(z, j)["h"])))
            places = F.sort_array(F.transform(hit, lambda j: F.get(z, j)["i"]))
            return let(places, lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                           lambda a, b: F.coalesce(F.least(F.lit(window), b - a), F.lit(window))),
                F.lit(0), lambda acc, n: acc + n))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, flagged))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, covered))


def measure(text: Column) -> list[Column]:
    """The measurements of a text; ``words`` are named in ``MEASURES``."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                            repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return [by_word.alias("by_word"), by_line.alias("by_line"),
            _only(text, f"{SPACE}+").alias("word_chars"),
            _only(text, f"[^{SYMBOLS}]+").alias("n_symbols"),
            _only(text, r"\P{Lu}+").alias("n_upper"),
            _only(text, r"\P{L}+").alias("n_letters"),
            _only(text, "[^!]+").alias("n_exclamations")]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the failure bits of all rules."""
    measured = docs.select("doc_id", *measure(F.col("text"))).select("doc_id", "by_word.*", "by_line.*", *MEASURES[1:3],
                                                                     *MEASURES[6:])
    bits = " + ".join(f"if({rule}, {1 << bit}L, 0L)" for bit, (_, rule) in enumerate(RULES))
    return measured.select("doc_id", *MEASURES, F.expr(bits).alias("failed"))


def mask(policy: str) -> int:
    place = {name: bit for bit, (name, _) in enumerate(RULES)}
    return sum(1 << place[name] for name in POLICIES[policy])


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` and ``failed_rules`` by one version of the policy."""
    counted = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    names = [F.when(counted.bitwiseAND(F.lit(1 << bit)) != 0, name) for bit, (name, _) in enumerate(RULES)]
    return entries.withColumn("kept", counted == 0).withColumn("failed_rules", F.array_compact(F.array(*names)))


def ablation(entries: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """policy, rule, n_failed, n_alone, n_kept, n_kept_without: what each rule of each policy does.

    Bit patterns are counted once; there are at most 2 to the number of rules of them.
    """
    policies = policies or list(POLICIES)
    pairs = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"),
                 F.lit(1 << bit).cast("long").alias("bit"))
        for p in policies for bit, (name, _) in enumerate(RULES) if name in POLICIES[p]])
    counted = entries.groupBy("failed").agg(F.count("*").alias("n"))
    seen = F.col("failed").bitwiseAND(F.col("mask"))
    without = seen.bitwiseAND(F.bitwise_not("bit"))

    def total(condition, name):
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return (counted.select("failed", "n", F.inline(pairs)).groupBy("policy", "rule")
            .agg(total(F.col("failed").bitwiseAND(F.col("bit")) != 0, "n_failed"),
                 total(seen == F.col("bit"), "n_alone"), total(seen == 0, "n_kept"),
                 total(without == 0, "n_kept_without")))


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, n_words, the base measurements, base_failed, kept and the failure bits."""
    entries = apply_policy(ledger(docs), policy)
    base = F.col("failed").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return entries.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & F.col("kept")).alias("kept"),
                          "failed")


#: DuckDB SQL for ``verdicts``.
ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
runs as (select row_number() over () as row, * from w),
windows as (
  select row, i, list_slice(words, i, i + 4) as win
  from runs, unnest(generate_series(1, len(words) - 4)) as u(i) where len(words) >= 5),
twice as (select row, win from windows group by row, win having count(*) > 1),
covered as (
  select row, count(distinct p) as n
  from (select w.row, unnest(generate_series(w.i, w.i + 4)) as p
        from windows w join twice using (row, win)) group by row),
m as (
  select doc_id, len(words)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         coalesce(c.n, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '\P{Lu}+', '', 'g'))::bigint as n_upper,
         length(regexp_replace(t, '\P{L}+', '', 'g'))::bigint as n_letters,
         length(regexp_replace(t, '[^!]+', '', 'g'))::bigint as n_exclamations
  from runs left join covered c using (row)),
f as (
  select *, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from m),
b as (
  select *,
    case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
    + case when 2 * n_upper > n_letters then 8 else 0 end
    + case when 10 * n_exclamations > 3 * n_words then 16 else 0 end
    + case when word_chars > 25 * n_words then 32 else 0 end
    + case when n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines then 64 else 0 end
    + case when 2 * n_letters < word_chars then 128 else 0 end as failed
  from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed,
       failed = 0 as kept, failed::bigint as failed
from b
"""
