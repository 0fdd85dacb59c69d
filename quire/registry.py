"""Where queries and their SQL are put by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return put


def over(name: str, views: tuple[str, ...], f: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers f over injected views."""
    query(name, sql)(lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views)))
