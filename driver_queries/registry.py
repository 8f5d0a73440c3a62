"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (tables) -> DataFrame under `name`, with the SQL of the same result."""

    def register(build):
        from argentum.session import pin
        from driver_queries.inputs import Tables

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(pin(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def with_(*parts: str) -> str:
    """Common table expressions followed by the final select."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
