"""Collects the checks: a Spark query each, and its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardspark.session import tuned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two checks named {name}")
        QUERIES[name] = lambda spark, sf: query(tuned(spark), sf)
        if sql:
            ORACLES[name] = sql
        return query

    return add
