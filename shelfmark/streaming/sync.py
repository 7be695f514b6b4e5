"""Keeping a chunk table in step with its wiki, as a stream of page versions.

Started by an external scheduler with an available-now trigger; each run picks
up what landed since the last one, so no look-back window is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.chunking import caption_chunks
from shelfmark.operators.merge import stale_pages
from shelfmark.plans.ingest import Profile, chunk_rows, newest_versions
from shelfmark.sources.pages import page_metadata
from shelfmark.sources.tables import PageTable


def apply_batch(table: PageTable, pages: DataFrame, profile: Profile, batch: str = "",
                captions: DataFrame | None = None) -> None:
    """Replace the chunks of every page in the batch; excluded pages are cleared.

    The new rows are computed and written before the old ones stop being
    visible. Caption chunks belong to their page's new rows.
    """
    newest = newest_versions(pages).persist()
    try:
        fresh = chunk_rows(newest, profile)
        if captions is not None:
            fresh = fresh.unionByName(caption_chunks(newest, captions), allowMissingColumns=True)
        table.replace(newest.select("page_id"), fresh.select(*table.columns), batch)
    finally:
        newest.unpersist()


def delete_stale(table: PageTable, live: DataFrame, spaces: DataFrame, batch: str = "") -> None:
    """Remove pages that are gone from the given spaces."""
    stored = table.read().select("space_key", "page_id").distinct()
    table.delete(stale_pages(stored, live, spaces).select("page_id").distinct(), batch)


def sync_stream(pages: DataFrame, table: PageTable, profile: Profile, checkpoint: str, base_url: str = "") -> StreamingQuery:
    """Start the sync; a batch that is retried after a failure is applied once."""

    def apply(batch: DataFrame, number: int) -> None:
        apply_batch(table, page_metadata(batch, base_url), profile, f"{checkpoint}#{number}")

    return (
        pages.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
