"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallypact.workload.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query. ``uses`` names the domain views the SQL reads, in dependency order."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(uses, sql)
        return fn

    return add


def with_views(uses: str, body: str) -> str:
    """Prefix ``body`` with the named views; CTEs written by the body itself follow them."""
    ctes = [f"{v} as ({VIEWS[v].strip()})" for v in uses.split()]
    body = body.strip()
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            ctes.append(body[len(opening):].strip())
            return opening + ",\n".join(ctes)
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
