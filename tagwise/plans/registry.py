"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where the semantics are SQL-expressible, the equivalent DuckDB SQL over the driver's
pre-registered views. Column names are aliased identically on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, sql: str | None = None, covers: str = ""):
    """Register ``fn`` under ``name`` with its oracle SQL and the inventory ids it covers."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        COVERS[name] = covers.split()
        return fn
    return deco
