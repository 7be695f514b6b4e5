"""Keyed table changes as joins: upsert, page replacement, deletion, counters.

Each function returns the table's new state; ``sources.tables`` writes it back
touching only the buckets that changed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: str, sequence: str | Column) -> DataFrame:
    """One row per key, the one with the highest sequence; combines map-side."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("__row"))
    return picked.select(key, "__row.*").select(*df.columns)


def upsert(
    base: DataFrame,
    updates: DataFrame,
    key: str,
    *,
    keep: tuple[str, ...] = (),
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Insert or overwrite by key; ``updates`` holds one row per key.

    Columns in ``keep`` survive an overwrite; for new rows they, and any column
    the updates lack, take their ``defaults``.
    """
    defaults = defaults or {}
    kept = [c for c in base.columns if c in keep or c not in updates.columns]
    kept = [c for c in kept if c != key]
    untouched = base.join(updates.select(key), key, "left_anti")
    if kept:
        old = base.select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in kept])
        joined = updates.join(old, key, "left")
    else:
        joined = updates

    def column(c: str) -> Column:
        if c not in kept:
            return F.col(c)
        new = defaults.get(c, F.col(c) if c in updates.columns else F.lit(None))
        return F.when(F.col("__known"), F.col(f"__{c}")).otherwise(new).alias(c)

    changed = joined.select(*[column(c) for c in base.columns])
    return untouched.unionByName(changed)


def replace_pages(
    base: DataFrame, touched: DataFrame, fresh: DataFrame, page: str = "page_id"
) -> DataFrame:
    """All rows of the touched pages give way to the fresh ones.

    A touched page without fresh rows ends up empty.
    """
    return base.join(touched.select(page).distinct(), page, "left_anti").unionByName(fresh)


def delete_pages(base: DataFrame, gone: DataFrame, page: str = "page_id") -> DataFrame:
    return base.join(gone.select(page), page, "left_anti")


def stale_pages(
    stored: DataFrame, live: DataFrame, spaces: DataFrame, exempt_prefix: str = "local_"
) -> DataFrame:
    """Stored pages of the given spaces that are no longer live.

    A space without any live page counts as a failed listing and is left alone.
    ``spaces`` has space_key; the other two have space_key and page_id.
    """
    listed = live.select("space_key").distinct().join(spaces, "space_key", "left_semi")
    candidates = (
        stored.where(~F.col("page_id").startswith(exempt_prefix))
        .select("space_key", "page_id")
        .distinct()
        .join(listed, "space_key", "left_semi")
    )
    return candidates.join(live, ["space_key", "page_id"], "left_anti")


def record_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Add hit counts and the latest hit time per ticket key."""
    counted = hits.groupBy("ticket_key").agg(
        F.count(F.lit(1)).alias("__hits"), F.max("hit_at").alias("__at")
    )
    joined = cache.join(counted, "ticket_key", "left")
    changed = {
        "hit_count": F.col("hit_count") + F.coalesce("__hits", F.lit(0)),
        "last_hit_at": F.coalesce("__at", "last_hit_at"),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in cache.columns])


def embedding_mismatches(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without a vector and vectors without a chunk; must be empty."""
    lonely = chunks.select(key).join(embeddings, key, "left_anti").select(key, F.lit("no vector").alias("problem"))
    extra = embeddings.select(key).join(chunks, key, "left_anti").select(key, F.lit("no chunk").alias("problem"))
    return lonely.unionByName(extra)
