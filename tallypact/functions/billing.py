"""Fees, frequencies, dues and schedule dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions.text import decimal_text


def _filled(col: Column) -> Column:
    return F.when(col != "", col)


def frequency_class(frequency: Column, calculation: Column | None = None) -> Column:
    """STRUCT(unit_basis, billing_class) of a fee's own wording."""
    parts = [_filled(frequency)] + ([] if calculation is None else [_filled(calculation)])
    text = F.trim(F.concat_ws(" ", *parts))

    def pair(basis, kind):
        return F.struct(F.lit(basis).alias("unit_basis"), F.lit(kind).alias("billing_class"))

    chain = F.when(text == "", pair(*fv.UNMATCHED_FREQUENCY))
    for pattern, basis, kind in fv.FREQUENCY_RULES:
        chain = chain.when(text.rlike(f"(?i){pattern}"), pair(basis, kind))
    return chain.otherwise(pair(*fv.UNMATCHED_FREQUENCY))


def fee_item(amount: Column, tiers: Column, rate_pct: Column, reading: Column,
             override_amount: Column, override_class: Column) -> Column:
    """The billed fee: an audit override wins, and both readings stay visible.

    NULL when there is no amount, no tier and no rate. ``corrected`` names the fields an override
    moved. ``reading`` is the STRUCT of :func:`frequency_class`.
    """
    billed = F.coalesce(override_amount, amount)
    kind = F.coalesce(override_class, reading.billing_class)
    basis_map = F.create_map(*[F.lit(x) for kv in fv.BASIS_FOR_CLASS.items() for x in kv])
    basis = F.when(override_class.isNotNull(),
                   F.coalesce(basis_map[override_class], reading.unit_basis)
                   ).otherwise(reading.unit_basis)
    corrected = F.filter(F.array(
        F.when(override_amount.isNotNull() & ~override_amount.eqNullSafe(amount), "amount"),
        F.when(override_class.isNotNull() & (override_class != reading.billing_class),
               "billing_class")), lambda x: x.isNotNull())
    fee = F.struct(
        billed.alias("amount"), rate_pct.alias("rate_pct"), basis.alias("unit_basis"),
        kind.alias("billing_class"), tiers.alias("tier_bands"), corrected.alias("corrected"),
        F.struct(amount.alias("amount"), reading.billing_class.alias("billing_class"))
        .alias("as_read"))
    unpriced = billed.isNull() & (F.coalesce(F.size(tiers), F.lit(0)) <= 0) & rate_pct.isNull()
    return F.when(~unpriced, fee)


def fee_line(amount: Column, rate_pct: Column, fee_type: Column, unit_basis: Column,
             minimum: Column, tiers: Column) -> Column:
    """A fee in one line of text; absent parts are left out."""
    prefix = F.when(fee_type == "cost_plus", "cost + ").otherwise("")
    bands = F.transform(tiers, lambda t: F.concat(
        F.lit("units "), t.min_units.cast("string"), F.lit("-"),
        F.coalesce(t.max_units.cast("string"), F.lit("∞")), F.lit(": $"),
        F.coalesce(decimal_text(t.amount), F.lit("None"))))
    return F.concat_ws(
        " · ",
        F.concat(F.lit("$"), decimal_text(amount)),
        F.concat(prefix, decimal_text(rate_pct), F.lit("%")),
        F.replace(_filled(unit_basis), F.lit("_"), F.lit(" ")),
        F.concat(F.lit("min $"), decimal_text(minimum)),
        bands)


def enters_dues(unit_basis: Column) -> Column:
    return unit_basis.rlike(fv.DUES_BASIS)


def tier_amount(tiers: Column, fleet: Column) -> Column:
    """Amount of the first band, in array order, that holds the fleet size."""
    hits = F.filter(tiers, lambda t: (fleet >= F.coalesce(t.min_units, F.lit(0)))
                    & (t.max_units.isNull() | (fleet <= t.max_units)))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1).amount)


def effective_fleet(assigned: Column, override: Column) -> Column:
    return F.when(override.isNotNull(), F.greatest(F.lit(1), override)).otherwise(
        F.greatest(F.lit(0), F.coalesce(assigned, F.lit(0)))).cast("bigint")


def fleet_source(override: Column) -> Column:
    return F.when(override.isNotNull(), "override").otherwise("derived")


def fleet_locked(status: Column) -> Column:
    return F.coalesce(status == "ACTIVE", F.lit(False))


def normalize_frequency(raw: Column) -> Column:
    text = F.lower(F.coalesce(raw, F.lit("")))
    return (F.when(text.contains("quarter"), "quarterly")
            .when(text.contains("year") | text.contains("annual"), "annual")
            .otherwise("monthly"))


def _cadence(frequency: Column, index: int) -> Column:
    monthly = fv.CADENCE["monthly"][index]
    return (F.when(frequency == "quarterly", fv.CADENCE["quarterly"][index])
            .when(frequency == "annual", fv.CADENCE["annual"][index]).otherwise(monthly))


def period_months(frequency: Column) -> Column:
    return _cadence(frequency, 0)


def schedule_length(frequency: Column) -> Column:
    return _cadence(frequency, 1)


def period_label(frequency: Column, start: Column) -> Column:
    year = F.year(start).cast("string")
    return (F.when(frequency == "quarterly",
                   F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), year))
            .when(frequency == "annual", year)
            .otherwise(F.date_format(start, "MMMM yyyy")))


def contract_end(end: Column, start: Column, term_months: Column) -> Column:
    return F.coalesce(end, F.add_months(start, term_months))


def billing_start(stored: Column, generated_at: Column, created_at: Column,
                  as_of: Column) -> Column:
    """First usable date: stored, the config's, the engagement's, else the analysis date."""
    def day(text):
        return F.to_date(F.try_to_timestamp(text))

    return F.coalesce(F.try_to_date(F.substring(stored, 1, 10)), day(generated_at),
                      day(created_at), as_of)


def schedule_status(paid: Column, due: Column, next_due: Column, as_of: Column) -> Column:
    return (F.when(paid, "paid").when(as_of < due, "upcoming")
            .when(as_of < next_due, "due").otherwise("overdue"))


def bucket_of(days: Column, buckets) -> Column:
    """Key of the day range that holds ``days``; ranges are listed in ascending order."""
    chain = None
    for key, _label, _low, high in buckets:
        if high is None:
            return chain.otherwise(F.lit(key))
        chain = F.when(days <= high, key) if chain is None else chain.when(days <= high, key)
    return chain


def pct(part: Column, whole: Column) -> Column:
    """Percentage to one place, zero when the whole is zero; exact on integer-valued inputs."""
    return rounded_ratio(part * 100, whole, 1)


def rounded_ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole rounded half up in integer arithmetic, zero when the whole is zero.

    Inputs are scaled to whole cents, so the result never depends on binary fractions.
    """
    num = (part.cast("decimal(28,2)") * 100).cast("decimal(30,0)")
    den = (whole.cast("decimal(28,2)") * 100).cast("decimal(30,0)")
    scale = 10 ** places
    doubled = (num * (2 * scale) + den).cast("decimal(36,0)")
    steps = F.floor(F.try_divide(doubled.cast("decimal(36,0)"), (den * 2).cast("decimal(32,0)")))
    return F.coalesce(F.when(den != 0, steps.cast("double") / scale), F.lit(0.0))
