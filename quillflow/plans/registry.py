"""All registered queries and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("scans", "observation_windows", "payer_windows", "scale_windows", "relations", "graphs", "evaluations", "models", "details")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that DuckDB answers alike."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for module in _MODULES:
        import_module(f"quillflow.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payer-side feature table of the recommended set."""
    from ..operators.features import sender_features
    from ..sources.tables import transactions

    return sender_features(transactions(spark, sf_dir), "compact_core_same_amount_spread_decay12h")
