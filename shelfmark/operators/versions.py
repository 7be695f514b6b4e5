"""A page table kept as a log of facts, in any order of arrival.

A fact is a row (kind, id, space_key, at, mark, payload): a ``version`` of a
page, its being ``listed``, its being ``deleted``, or a ``listing`` of a space
(whose id is the space). Only the newest fact of a kind and id counts, by
(at, mark), and the newest of several is the same whatever order they come in
and however often. So late older versions, repeated deliveries and listings that
overtake pages lead to the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "kind string, id string, space_key string, at long, mark long, payload string"


def facts(rows: DataFrame) -> DataFrame:
    """Adds ``mark``, which tells payloads of one time apart; rows without a kind, id or time are no facts."""
    usable = rows.where(F.col("kind").isNotNull() & F.col("id").isNotNull() & F.col("at").isNotNull())
    return usable.withColumn("mark", F.xxhash64("space_key", "payload")).select("kind", "id", "space_key", "at", "mark", "payload")


def newest(log: DataFrame) -> DataFrame:
    """The newest fact of every kind and id; combined map-side, so a fact that was sent very often is no problem."""
    rest = F.max_by(F.struct("space_key", "payload"), F.struct("at", "mark"))
    found = log.groupBy("kind", "id").agg(F.max(F.struct("at", "mark")).alias("n"), rest.alias("r"))
    return found.select("kind", "id", "r.space_key", "n.at", "n.mark", "r.payload")


def live_pages(log: DataFrame) -> DataFrame:
    """(page_id, space_key, at, mark, payload) of the newest version of every page that is there.

    A page is gone when a deletion is as new as its version, or when the newest
    listing of its space is newer than the version and than the page's being
    listed. A space without a listing keeps its pages.
    """
    known = newest(log)
    of = lambda kind: known.where(F.col("kind") == kind)
    seen = of("deleted").select("id", F.col("at").alias("gone_at"), F.lit(None).cast("long").alias("listed_at"))
    seen = seen.unionByName(of("listed").select("id", F.lit(None).cast("long").alias("gone_at"), F.col("at").alias("listed_at")))
    seen = seen.groupBy("id").agg(F.max("gone_at").alias("gone_at"), F.max("listed_at").alias("listed_at"))
    heads = of("listing").select(F.col("id").alias("space_key"), F.col("at").alias("head_at"))
    pages = of("version").drop("kind").join(seen, "id", "left").join(heads, "space_key", "left")
    there = (F.col("gone_at").isNull() | (F.col("at") > F.col("gone_at"))) & (
        F.col("head_at").isNull() | (F.greatest("at", F.coalesce("listed_at", "at")) >= F.col("head_at"))
    )
    return pages.where(there).select(F.col("id").alias("page_id"), "space_key", "at", "mark", "payload")


def live_chunks(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunk rows (with page_id, at and mark of the version they were cut from) of live versions; others wait for a clean-up."""
    return chunks.join(live_pages(log).select("page_id", "at", "mark"), ["page_id", "at", "mark"], "left_semi")
