"""Registered queries over the given tables, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("search", "evaluation", "answers", "storage", "texts", "chats", "tickets", "records", "lifecycles", "syncing")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where it can be said in SQL, its twin."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
