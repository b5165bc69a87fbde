"""Text keys: names, slugs, quote streams and word sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv


def _words(name: Column) -> Column:
    """Lower-case words with bracketed asides, punctuation and filler removed, and single spaces between them."""
    text = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\([^)]*\)", " ")
    text = F.regexp_replace(text, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(text, rf"(?:(?<= )|^)(?:(?:{'|'.join(fv.NAME_STOPWORDS)})(?: |$))+", ""))


def normalise_name(name: Column) -> Column:
    """The comparison key of a service name; plural words of five letters or more lose their s."""
    return F.regexp_replace(_words(name), "(?<=[a-z0-9]{3}[a-rt-z0-9])s(?= |$)", "")


def slugify(name: Column) -> Column:
    """A readable id for a catalog entry."""
    return F.regexp_replace(F.translate(_words(name), " ", "-"), "^$", "unnamed")


def norm_text(text: Column) -> Column:
    """Letters, digits and money or rate signs only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9$%/-]", "")


def scoring_text(text: Column) -> Column:
    """Lower case with punctuation as single spaces."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def key_words(text: Column) -> Column:
    """The set of significant words of a text, sorted."""
    noise = F.array(*[F.lit(w) for w in ["", *fv.SCORING_NOISE]])
    return F.array_sort(F.array_except(F.split(scoring_text(text), " "), noise))


def clean_heading(raw: Column) -> Column:
    """The program name in a pricing-schedule heading, or NULL when the cell is no heading."""
    found = F.regexp_extract(F.trim(F.regexp_replace(raw, r"\s+", " ")), fv.HEADING_PATTERN, 1)
    name = F.regexp_replace(found, r"(?i)\s*\(SECTION[^)]*\)\s*$", "")
    # Title case restarts after every non-letter, so the name is cut between letters and the rest.
    runs = F.regexp_extract_all(name, F.lit("([A-Za-z]+|[^A-Za-z]+)"))
    name = F.array_join(F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                 F.lower(F.substr(r, F.lit(2), F.length(r))))), "")
    name = F.regexp_replace(name, r"^(?:[A-Z]\s+)+(?=[A-Z][a-z])", "")
    for wrong, right in fv.ACRONYMS:
        name = F.replace(name, F.lit(wrong), F.lit(right))
    name = F.trim(name)
    return F.when(F.length(name) > 8, name)


def decimal_text(amount: Column) -> Column:
    """Money as shown: no trailing zeros, no point on whole amounts."""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def long_date(day: Column) -> Column:
    return F.date_format(day, "dd MMM yyyy")
