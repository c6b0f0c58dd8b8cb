"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(names: str, sql: str) -> str:
    """``sql`` with the named views (and those they need) in front as CTEs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEWS[name]
        for n in needs.split():
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    body = sql.strip()
    recursive = body.startswith("WITH RECURSIVE")
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in wanted]
    if body.startswith("WITH"):
        body = body.removeprefix("WITH RECURSIVE" if recursive else "WITH").strip()
        ctes_text = ",\n".join(ctes) + (",\n" if ctes else "")
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes_text}{body}"
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query, and its SQL twin over the named views."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def rnd(expression: str, digits: int = 6) -> str:
    """SQL rounding as :func:`incidentlab.functions.scalar.rounded` does it: half-up on the decimal value."""
    exact = f"TRY_CAST(CAST({expression} AS DOUBLE) AS DECIMAL(38, {digits + 5}))"
    return f"CAST(round({exact}, {digits}) AS DOUBLE)"
