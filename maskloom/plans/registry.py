"""Registry of named queries, each with an independent SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(value, digits: int = 6) -> Column:
    """Round half up by arithmetic, so that every engine gives the same double."""
    scale = F.lit(float(10 ** digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def rounded_sql(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * {10 ** digits}::DOUBLE + 0.5::DOUBLE) / {10 ** digits}::DOUBLE)"
