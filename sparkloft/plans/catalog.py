"""Registry of the engine's queries: each is an operator applied to engine tables, with the oracle SQL beside it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloft import views

_FAMILIES = ("records", "retrieval", "graph", "ingest", "telemetry", "more", "store", "knowledge", "sources", "cases")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str):
    """Registers ``f(t, spark, sf_dir)``, where t(name) is an engine or base table; ``tables`` are the projections that the SQL uses."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: views.view(spark, sf_dir, table), spark, sf_dir)

        run.__name__ = name
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = views.with_views(sql, *tables) if tables else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at six places, as in the oracle."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"sparkloft.plans.queries_{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
