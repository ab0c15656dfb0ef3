"""Every registered query of the layout operators: name -> (spark, sf_dir) -> DataFrame, and its SQL twin. ``pagewright.queries`` fills it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.derive import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a query under its function's name; ``sql`` reads the derived ``tables``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql, *tables)
        return f

    return add
