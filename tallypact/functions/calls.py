"""Cost and completeness of model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv


def price_of(model: Column) -> Column:
    """STRUCT of a model's prices; the longest family name found in the id decides.

    The family list is fixed, so this is a CASE ordered from the longest name, not a join.
    """
    chain = None
    low = F.lower(model)
    for family in sorted(fv.MODEL_PRICES, key=lambda f: (-len(f), f)):
        base, out, write, read, cap = fv.MODEL_PRICES[family]
        row = F.struct(
            F.lit(family).alias("family"),
            _rate(base).alias("input"), _rate(out).alias("output"),
            _rate(base * fv.CACHE_WRITE_FACTOR if write is None else write).alias("cache_write"),
            _rate(base * fv.CACHE_READ_FACTOR if read is None else read).alias("cache_read"),
            F.lit(cap).alias("max_output_tokens"))
        hit = low.contains(family)
        chain = F.when(hit, row) if chain is None else chain.when(hit, row)
    return chain


def _rate(dollars: float) -> Column:
    return F.lit(f"{dollars:.6f}").cast("decimal(12,6)")


def _n(col: Column) -> Column:
    return F.coalesce(col, F.lit(0)).cast("decimal(16,0)")


def _dollars(per_million: Column) -> Column:
    """Exact decimal arithmetic, so a half cent never depends on binary fractions."""
    return F.round(per_million.cast("decimal(30,6)") * F.lit("0.000001").cast("decimal(7,6)"),
                   6).cast("double")


def call_cost_usd(price: Column, tokens_in: Column, tokens_out: Column, cache_read: Column,
                  cache_write: Column) -> Column:
    """Cost of a call to six places, NULL when the model is unknown."""
    total = (_n(tokens_in) * price.input + _n(tokens_out) * price.output
             + _n(cache_read) * price.cache_read + _n(cache_write) * price.cache_write)
    return _dollars(total)


def uncached_cost_usd(price: Column, tokens_in: Column, tokens_out: Column, cache_read: Column,
                      cache_write: Column) -> Column:
    """The same call had nothing been cached."""
    billed = _n(tokens_in) + _n(cache_read) + _n(cache_write)
    return _dollars(billed * price.input + _n(tokens_out) * price.output)


def truncated(overflowed: Column, salvaged: Column, stop_reason: Column, tokens_out: Column,
              cap: Column) -> Column:
    """Whether an answer came back cut off."""
    unclean = (F.coalesce(stop_reason, F.lit("")) != "") & ~F.lower(
        F.coalesce(stop_reason, F.lit(""))).isin(fv.CLEAN_STOP_REASONS)
    spent = F.coalesce((cap > 0) & (_n(tokens_out) >= cap - fv.BUDGET_SLACK), F.lit(False))
    return overflowed | salvaged | unclean | spent
