"""Reading an agreement's type, date and sanity off its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions.binding import let

FLAGS = "(?iU)"


def _mentions(text: Column, low: Column, phrases: str, hints: list[str]) -> Column:
    """Phrase count. The regex runs only over texts holding a word every phrase needs."""
    worth_it = low.contains(hints[0])
    for hint in hints[1:]:
        worth_it = worth_it | low.contains(hint)
    return F.when(worth_it, F.regexp_count(text, F.lit(FLAGS + phrases))).otherwise(F.lit(0))


def classify_doc_type(text: Column) -> Column:
    """STRUCT(doc_type, confidence) by weight of lease and service phrases.

    On a tie the phrase the document leads with decides.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    mentions = F.struct(
        _mentions(text, low, fv.LEASE_PHRASES, ["lease"]).alias("lease"),
        _mentions(text, low, fv.SERVICE_PHRASES, ["agreement", "statement"]).alias("service"))
    return let(mentions, lambda m: _weigh(text, m.lease, m.service))


def _weigh(text: Column, lease: Column, service: Column) -> Column:
    lease_first = (F.regexp_instr(text, F.lit(FLAGS + fv.LEASE_PHRASES))
                   < F.regexp_instr(text, F.lit(FLAGS + fv.SERVICE_PHRASES)))
    top, other = F.greatest(lease, service), F.least(lease, service)
    weight = F.bround(F.least(F.lit(0.99), F.lit(0.6) + F.lit(0.4) * (top - other) / top), 2)

    def out(kind, confidence):
        return F.struct(kind.alias("doc_type"), confidence.alias("confidence"))

    return (F.when((lease == 0) & (service == 0), out(F.lit("UNKNOWN"), F.lit(0.0)))
            .when(lease == service,
                  out(F.when(lease_first, "MLA").otherwise("MSA"), F.lit(0.6)))
            .otherwise(out(F.when(lease > service, "MLA").otherwise("MSA"), weight)))


def _date_from(year: Column, month: Column, day: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")
    return let(made, lambda m: F.when((F.year(m) > 1900) & (F.year(m) < 2200), m))


def effective_date(text: Column) -> Column:
    """The agreement's effective date; the wordings are tried in order, not by position."""
    head = F.coalesce(text, F.lit(""))
    names = F.array(*[F.lit(m) for m in fv.MONTHS])
    either = "|".join(fv.MONTHS)
    day = r"(\d{1,2})(?:st|nd|rd|th)?"

    def month_of(col):
        return F.array_position(names, F.lower(col)).cast("string")

    def reader(pattern, year, month, day_group, named=True):
        def parts(found):
            def part(group):
                return F.regexp_extract(found, FLAGS + pattern, group)

            return _date_from(part(year), month_of(part(month)) if named else part(month),
                              part(day_group))

        return let(F.regexp_substr(head, F.lit(FLAGS + pattern)), parts)

    lead = fv.EFFECTIVE_LEAD
    low = F.lower(head)
    return F.when(low.contains("effective") | low.contains("dated"), F.coalesce(
        reader(lead + rf"({either})\s+{day},?\s+(\d{{4}})", 3, 1, 2),
        reader(lead + rf"{day}\s+({either}),?\s+(\d{{4}})", 3, 2, 1),
        reader(lead + r"(\d{4})-(\d{2})-(\d{2})", 1, 2, 3, named=False)))


def sanity_reasons(text: Column, client_name: Column, expected: Column) -> Column:
    """Array of reasons why a re-upload looks wrong; empty when it passes."""
    low = F.lower(text)
    skip = F.array(*[F.lit(w) for w in fv.ENTITY_STOPWORDS])
    tokens = F.filter(F.split(F.lower(client_name), r"(?U)\W+"),
                      lambda t: (F.length(t) > 3) & ~F.array_contains(skip, t))
    msa = low.contains("master service agreement")
    mla = low.contains("master lease agreement")
    return F.filter(F.array(
        F.when((F.size(tokens) > 0) & ~F.exists(tokens, lambda t: F.contains(low, t)),
               F.concat(F.lit("document does not mention the client '"), client_name,
                        F.lit("'"))),
        F.when((expected == "MSA") & mla & ~msa,
               "expected an MSA but the document reads as a Master Lease Agreement"),
        F.when((expected == "MLA") & msa & ~mla,
               "expected an MLA but the document reads as a Master Service Agreement"),
    ), lambda r: r.isNotNull())


def scope_of(has_lease: Column, has_service: Column) -> Column:
    return (F.when(has_lease & has_service, "LEASE_AND_SERVICE")
            .when(has_lease, "LEASE_ONLY").when(has_service, "SERVICE_ONLY"))


def required_types(scope: Column) -> Column:
    def types(key):
        return F.array(*[F.lit(t) for t in fv.REQUIRED_DOC_TYPES[key]])

    return (F.when(scope == "LEASE_ONLY", types("LEASE_ONLY"))
            .when(scope == "SERVICE_ONLY", types("SERVICE_ONLY"))
            .otherwise(types("LEASE_AND_SERVICE")))


def page_tokens(text: Column, rows: Column | None = None) -> Column:
    """A quarter of the characters of a page and its table cells (three more per cell)."""
    chars = F.length(F.coalesce(text, F.lit("")))
    if rows is not None:
        chars = chars + F.coalesce(F.aggregate(
            F.flatten(rows), F.lit(0),
            lambda acc, cell: acc + F.length(F.coalesce(cell, F.lit(""))) + 3), F.lit(0))
    return F.floor(chars / 4).cast("int")


def table_block(page_number: Column, index: Column, rows: Column) -> Column:
    """A detected table as pipe-delimited text; empty cells keep their column."""
    lines = F.transform(rows, lambda row: F.concat(
        F.lit("| "),
        F.array_join(F.transform(row, lambda c: F.trim(F.replace(
            F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))), " | "),
        F.lit(" |")))
    head = F.concat(F.lit("----- PAGE "), page_number.cast("string"), F.lit(" TABLE "),
                    index.cast("string"), F.lit(" ("), F.size(rows).cast("string"),
                    F.lit(" rows) -----"))
    return F.array_join(F.concat(F.array(head), lines), "\n")


def page_marked_text(pages: Column) -> Column:
    """Pages (ARRAY of STRUCT(page_number, lines)) as one text with page markers."""
    return F.array_join(F.transform(pages, lambda p: F.concat(
        F.lit("===== PAGE "), p.page_number.cast("string"), F.lit(" =====\n"),
        F.array_join(p.lines, "\n"))), "\n\n")
