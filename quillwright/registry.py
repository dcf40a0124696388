"""Registry of the library's own queries. A query's name starts with the ids of the operators that it covers."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.adapters import Tables, oracle

FLAGSHIP = "a13_daily_applications_dense"
MODULES = [
    "operators.filters",
    "operators.joins",
    "operators.aggregates",
    "operators.ranking",
    "operators.sets",
    "operators.scalars",
    "operators.rules",
    "operators.resolve",
    "operators.cascade",
    "operators.aliases",
    "operators.company_model",
    "operators.dedup",
    "operators.rollup",
    "operators.audits",
    "operators.learning",
    "operators.reports",
    "streaming.flows",
]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``, with its DuckDB SQL where SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _ORACLES[name] = oracle(sql)
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    for module in MODULES:
        importlib.import_module(f"quillwright.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
