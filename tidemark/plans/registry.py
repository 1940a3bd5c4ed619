"""Named queries: each takes (spark, sf_dir) and returns a DataFrame; most have SQL beside them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("temporal", "aggregates", "windows", "retrieval", "graph", "text", "events", "memory", "scalars", "spans", "curation", "corpora", "links", "claims")
Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "hybrid_query"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def operator(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if oracle:
            _SQL[key] = oracle
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
