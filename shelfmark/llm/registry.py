"""The subpackage's registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = (
    "exact_index", "line_chunks", "bpe", "decontaminate", "quality", "near_dedup", "suffix_dedup", "url_filter", "secrets", "html_main",
    "quality_rules", "walsh_clusters", "token_alignment",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where it can be said in SQL, its twin."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__package__}.{module}")
