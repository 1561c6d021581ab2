"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.plans import oracles, parsing, records, reference, scoring

_MODULES = (records, reference, parsing, scoring)
_SQL = (*_MODULES, oracles)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _SQL for name, sql in module.SQL.items()}
