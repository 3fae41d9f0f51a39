"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import audits, features, graphs, pages, searches, tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (tables, graphs, searches, audits, pages, features)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.CATALOG.items() if sql}
