"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` together with its SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(value, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Round some columns of a result."""
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def sr(expr: str, name: str, digits: int = 6) -> str:
    """The SQL twin of :func:`r`."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"
