"""All named queries of the core and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_graph, queries_periods, queries_rows, queries_text

MODULES = (queries_periods, queries_text, queries_rows, queries_graph)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each takes the session and the folder of the tables."""
    return {name: q for module in MODULES for name, q in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    """The SQL with the same result, of the queries that have one."""
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
