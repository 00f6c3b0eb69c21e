"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def projected(name: str, source: Callable, sql_source: str, table: str, spark_columns: list[str], duck_columns: list[str]) -> None:
    """A query that only derives columns of a binding."""
    QUERIES[name] = lambda spark, sf_dir: source(spark, sf_dir).selectExpr(*spark_columns)
    ORACLES[name] = f"WITH {sql_source} SELECT {', '.join(duck_columns)} FROM {table}"
