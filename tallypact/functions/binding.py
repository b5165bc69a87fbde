"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it.

    A plain expression tree repeats a shared part at every mention inside CASE and COALESCE.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
