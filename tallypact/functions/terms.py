"""Identity, titles and review rules of extracted terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions.text import norm_text


def category_of(info_type: Column) -> Column:
    chain = None
    for key, value in fv.CATEGORY_OF.items():
        chain = F.when(info_type == key, value) if chain is None else chain.when(
            info_type == key, value)
    return chain


def lenient_code(col: Column, allowed: list[str], default: str) -> Column:
    """A code in any letter case of its member name; unknown codes fall back, NULL stays NULL."""
    chain = F.when(col.isNull(), F.lit(None).cast("string")).when(col.isin(allowed), col)
    return chain.when(col.isin([a.upper() for a in allowed]), F.lower(col)).otherwise(
        F.lit(default))


def _by_type(info_type: Column, fields: dict, build, default: Column) -> Column:
    chain = None
    for key, names in fields.items():
        chain = F.when(info_type == key, build(names)) if chain is None else chain.when(
            info_type == key, build(names))
    return chain.otherwise(default)


def identity_text(info_types: list[str] | None = None) -> Column:
    """Pipe-joined identity of a record; reads the record columns by name.

    A table that holds some record types only names them, and needs only their columns.
    """
    info_type = F.col("info_type")
    fields = {k: v for k, v in fv.IDENTITY_FIELDS.items() if info_types is None
              or k in info_types}

    def keys(names):
        return F.concat_ws("|", *[norm_text(F.coalesce(F.col(n), F.lit(""))) for n in names])

    base = F.concat_ws("|", info_type, _by_type(info_type, fields, keys, F.lit("")))
    money = F.concat_ws(
        "|", F.coalesce(F.col("amount").cast("decimal(18,2)").cast("string"), F.lit("None")),
        F.when(F.col("included"), "True").otherwise("False"))
    return F.concat_ws("|", base, F.when(info_type == "pricing_item", money))


def record_id(info_types: list[str] | None = None) -> Column:
    """A stable id: the same term read twice is the same row, a moved amount is another."""
    return F.substring(F.sha1(identity_text(info_types)), 1, 16)


def line_key() -> Column:
    """What makes two pricing records the same line, whatever they charge."""
    return F.concat_ws("|", *[norm_text(F.coalesce(F.col(n), F.lit("")))
                              for n in fv.IDENTITY_FIELDS["pricing_item"]])


def body_hash(columns: list[str]) -> Column:
    """Digest of everything a person reads; the caller leaves out what the system assigns."""
    parts = [F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("")))
             for c in sorted(columns)]
    return F.sha1(F.concat_ws("\u001f", *parts))


def titles() -> Column:
    """STRUCT(title, subtitle) of a record; reads the record columns by name."""
    info_type = F.col("info_type")

    def filled(name):
        return F.when(F.col(name) != "", F.col(name)) if name else F.lit(None).cast("string")

    title = _by_type(info_type, fv.TITLE_FIELDS, lambda p: filled(p[0]),
                     F.lit(None).cast("string"))
    title = F.coalesce(title, F.when(info_type == "pricing_item", filled("program")), info_type,
                       F.lit("Untitled"))
    subtitle = _by_type(info_type, fv.TITLE_FIELDS, lambda p: filled(p[1]),
                        F.lit(None).cast("string"))
    repeated = F.lower(F.trim(subtitle)) == F.lower(F.trim(title))
    return F.struct(title.alias("title"),
                    F.when(~repeated, subtitle).alias("subtitle"))


def _unpriced_line() -> Column:
    item = F.coalesce(F.col("item"), F.lit("")) != ""
    no_formula = F.coalesce(F.col("calculation"), F.lit("")) == ""
    return ((F.col("info_type") == "pricing_item") & item & ~F.coalesce(
        F.col("included"), F.lit(False)) & F.col("amount").isNull() & no_formula
        & (F.coalesce(F.size("tier_bands"), F.lit(0)) <= 0))


def needs_review(threshold: float = fv.REVIEW_THRESHOLD) -> Column:
    """Whether a person should look first; reads the record columns by name."""
    unsure = F.coalesce(F.col("confidence"), F.lit(0)) <= F.lit(threshold)
    uncited = F.coalesce(F.size("citations"), F.lit(0)) <= 0
    unplaced = (F.col("info_type") == "pricing_item") & F.coalesce(
        F.col("catalog_match").isin("fuzzy", "unmatched"), F.lit(False))
    return unsure | uncited | unplaced | _unpriced_line()


def review_flags(threshold: float = fv.REVIEW_THRESHOLD) -> Column:
    """Array of reasons to review a record."""
    confidence = F.coalesce(F.col("confidence"), F.lit(0)).cast("decimal(6,2)")
    return F.filter(F.array(
        F.when(confidence <= F.lit(threshold),
               F.concat(F.lit("confidence "), confidence.cast("string"))),
        F.when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, "no citation"),
        F.when(_unpriced_line(), "priced line with no price")), lambda r: r.isNotNull())


def completeness(columns: list[str]) -> Column:
    """How many of the given fields hold something."""
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(c).cast("string") != "", 1).otherwise(0)
    return total


def review_sort_key(needs: Column, confidence: Column) -> Column:
    """Text that sorts the review queue: needs-review first, then ascending confidence."""
    return F.concat(F.lit("RV#"), F.when(needs, "0").otherwise("1"), F.lit("#C#"),
                    F.lpad(F.bround(confidence * 100, 0).cast("int").cast("string"), 3, "0"))


def override_change(before: Column, after: Column, before_class: Column,
                    after_class: Column) -> Column:
    """What an audit correction changed, in words."""
    def shown(col):
        return F.coalesce(col.cast("string"), F.lit("None"))

    text = F.concat_ws(
        ", ",
        F.when(after.isNotNull() & ~after.eqNullSafe(before),
               F.concat(F.lit("amount "), shown(before), F.lit(" -> "), shown(after))),
        F.when(after_class.isNotNull() & ~after_class.eqNullSafe(before_class),
               F.concat(F.lit("billed as "), F.coalesce(before_class, F.lit("read")),
                        F.lit(" -> "), after_class)))
    return F.when(text == "", "no change").otherwise(text)
