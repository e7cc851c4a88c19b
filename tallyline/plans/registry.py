"""Registered queries: name -> Spark callable, and name -> the SQL it is checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.session import compiled
from tallyline.sources.driver_tables import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    """Add a named common table expression other checks can build on."""
    CTES[name] = (needs, sql)


def with_ctes(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    # materialized: several checks read one expression many times
    body = body.strip()
    glue = ",\n" + body[5:] if body.lower().startswith("with ") else f"\n{body}"
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order) + glue


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Register a query under its inventory name, with the SQL that must give the same rows (if any can)."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = functools.wraps(fn)(lambda spark, d: fn(compiled(spark), d))
        if sql is not None:
            ORACLES[name] = with_ctes(needs or [], sql)
        return fn

    return wrap
