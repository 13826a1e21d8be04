"""Names, builders and SQL of the geometric queries, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


from . import field_queries, mesh_queries, other_queries, shape_queries  # noqa: E402, F401  (they register themselves)
