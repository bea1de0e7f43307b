"""The query registry and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.catalog import domain_sql
from aerolens.session import compiled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register a query; `uses` names the derived tables its SQL reads, `sql` is left out where SQL cannot say it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            compiled(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = domain_sql.statement(uses.split(), sql)
        return fn

    return register


def R(value: Column, digits: int = 6) -> Column:
    """Round a measured value for comparison between engines."""
    return F.round(value, digits)


def r(expr: str, digits: int = 6) -> str:
    """The SQL side of `R`; adding zero turns a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0e0)"
