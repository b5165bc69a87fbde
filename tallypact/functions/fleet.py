"""Vehicle codes and invariants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv


def duty_band(body_class: Column, stored: Column | None = None) -> Column:
    chain = None
    for band, bodies in fv.DUTY_BANDS.items():
        hit = body_class.isin(bodies)
        chain = F.when(hit, band) if chain is None else chain.when(hit, band)
    return chain if stored is None else chain.otherwise(stored)


def vehicle_problem(ownership: Column, status: Column, customer_id: Column) -> Column:
    """Why a vehicle row is not allowed, or NULL."""
    owned = ownership == "CUSTOMER_OWNED"
    return (F.when(owned & (status == "IN_STOCK"), "a customer-owned vehicle cannot be IN_STOCK")
            .when(owned & customer_id.isNull(),
                  "a customer-owned vehicle requires a customer_id"))


def is_available(ownership: Column, status: Column) -> Column:
    return (ownership == "PROVIDER_OWNED") & (status == "IN_STOCK")


def released_status(ownership: Column) -> Column:
    return F.when(ownership == "PROVIDER_OWNED", "IN_STOCK").otherwise("ON_ORDER")
