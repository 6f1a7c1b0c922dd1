"""All registered queries of the engine, by id, with the SQL that checks them."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import DERIVED_SQL, Tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("ingest", "chunking", "vectors", "lexical", "fusion", "answering", "sheets", "quality", "usage", "business", "streams")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Adds a query: a plan over the tables of a folder and, where SQL can express it, the SQL that gives the same rows."""
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    if sql:
        _SQL[name] = with_derived(sql)


def with_derived(sql: str) -> str:
    """The SQL with definitions of the derived tables that it mentions, and of those that these mention, put in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in DERIVED_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    front = ", ".join(f"{n} AS ({DERIVED_SQL[n]})" for n in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {front}, {body[15:]}"
    return f"WITH {front}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {front} {body}"


@lru_cache(1)
def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tessera.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["E07_hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
