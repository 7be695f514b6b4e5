"""From pages to the new state of a chunk table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.chunking import chunk_pages
from shelfmark.operators.embedding import hashed_words
from shelfmark.operators.filters import EXCLUDED_LABELS, keep_by_labels
from shelfmark.operators.merge import latest_by_key


@dataclass(frozen=True)
class Profile:
    """One experiment: how pages are cut and how chunks get their vectors."""

    name: str = "default"
    chunker: str = "html_section"
    chunker_params: Mapping[str, Any] = field(default_factory=dict)
    dimensions: int = 64
    include_labels: Sequence[str] | None = None
    exclude_labels: Sequence[str] | None = EXCLUDED_LABELS


def newest_versions(pages: DataFrame) -> DataFrame:
    """One row per page: the highest version, then the latest change."""
    return latest_by_key(pages, "page_id", F.struct("version", "last_modified"))


def kept_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    return pages.where(keep_by_labels(F.col("labels"), profile.include_labels, profile.exclude_labels))


def chunk_rows(pages: DataFrame, profile: Profile) -> DataFrame:
    """Chunks with vectors; label filtering comes first, Python work last."""
    chunks = chunk_pages(kept_pages(pages, profile), profile.chunker, profile.chunker_params)
    return hashed_words(chunks, "content", width=profile.dimensions)


def page_status(keep: Column, n_chunks: Column, error: Column | None = None) -> Column:
    """What became of a page in a run."""
    failed = F.when(error.isNotNull(), "failed") if error is not None else F.when(F.lit(False), "failed")
    return failed.when(~keep, "skipped").when(n_chunks == 0, "empty").otherwise("processed")


def run_counters(pages: DataFrame) -> DataFrame:
    """Pages and chunks by status; ``pages`` has status and n_chunks."""
    return pages.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("n_chunks")
    )
