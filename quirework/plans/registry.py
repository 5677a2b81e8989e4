"""Every registered query and its SQL. The modules that fill it are imported at the end."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans.fixtures import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may name derived tables, which are put in front."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(sql)
        return f

    return add


MODULES = ("selection", "text", "editlog", "structure", "stamps", "live")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"quirework.plans.{m}")
