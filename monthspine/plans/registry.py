"""Catalogue of registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a plan built from the fixtures; ``needs`` lists fixture views used by ``sql``."""

    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            _SQL[name] = (needs.split(), sql)
        return fn

    return deco


def oracles() -> dict[str, str]:
    """DuckDB text of every checked query, with the views it needs."""
    return {name: with_fixtures(needs, sql) for name, (needs, sql) in _SQL.items()}
