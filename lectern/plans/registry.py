"""The table of registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.domain import Domain
from lectern.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(Domain) -> DataFrame` under `name`, with its DuckDB text if any."""

    def register(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
