"""Keeping pages in step with their spaces: versions, listings and deletions over the ``pages`` table, in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import attachments as at
from shelfmark.operators.chunking import caption_chunks
from shelfmark.operators.versions import facts, live_pages
from shelfmark.plans.registered import query, table
from shelfmark.streaming.lifecycle import replay
from shelfmark.streaming.versions import newest_stream

SLICES = 3
IMAGE_BYTES = 20_000
LISTINGS = (150, 270)

SYNC_SQL = """page AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS space_key, html FROM pages),
versions AS (
  SELECT page_id, space_key, v * 100 + page_id % 50 AS version_at, md5(coalesce(html, '') || v) AS payload FROM page, range(1, 4) AS r(v)
  WHERE v < 3 OR page_id % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY v DESC) = 1)
SELECT page_id::VARCHAR AS page_id, space_key, version_at, payload FROM versions
WHERE NOT page_id % 11 = 0
  AND greatest(version_at, CASE WHEN page_id % 7 <> 0 AND page_id % 3 <> 1 THEN 270 WHEN page_id % 3 <> 0 THEN 150 ELSE 0 END) >= 270"""


def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three versions of every page, two listings of every space, and deletions, some of them older than a version."""
    pages = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("space_key"), "html")
    number, nothing = F.col("page_id"), F.lit(None).cast("string").alias("payload")
    id_ = number.cast("string").alias("id")

    def said(kind: str, rows: DataFrame, at: F.Column, payload: F.Column = nothing, name: F.Column = id_) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), name, "space_key", at.cast("long").alias("at"), payload)

    versions = pages.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(3)))).where("v < 3 OR page_id % 5 != 0")
    digest = F.md5(F.concat(F.coalesce("html", F.lit("")), F.col("v").cast("string"))).alias("payload")
    spaces = pages.select("space_key").distinct().withColumn("l", F.explode(F.array(*map(F.lit, LISTINGS))))
    parts = [
        said("version", versions, F.col("v") * 100 + number % 50, digest),
        said("listed", pages.where("page_id % 3 != 0"), F.lit(LISTINGS[0])),
        said("listed", pages.where("page_id % 7 != 0 AND page_id % 3 != 1"), F.lit(LISTINGS[1])),
        said("listing", spaces, F.col("l"), name=F.col("space_key").alias("id")),
        said("deleted", pages.where("page_id % 11 = 0"), F.lit(400)),
        said("deleted", pages.where("page_id % 13 = 0"), F.lit(120)),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return facts(every)


@query("sync_versions", f"WITH {SYNC_SQL}")
def sync_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that are there, from all facts at once."""
    return live_pages(page_facts(spark, folder)).select("page_id", "space_key", F.col("at").alias("version_at"), "payload")


@query("sync_replay", f"WITH {SYNC_SQL}")
def sync_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream that gets the facts in shuffled order."""
    rows = page_facts(spark, folder)
    shuffled = F.pmod(F.xxhash64("kind", "id", "at"), F.lit(SLICES))
    return live_pages(replay(rows, shuffled, SLICES, newest_stream)).select("page_id", "space_key", F.col("at").alias("version_at"), "payload")


IMAGES_SQL = f"""images AS (
  SELECT page_id, 'a' || page_id AS attachment_id, page_id || '.png' AS filename, octet_length(encode(html)) AS n, md5(html) AS digest
  FROM pages WHERE page_id % 4 <> 0 AND octet_length(encode(html)) <= {IMAGE_BYTES}),
captioned AS (
  SELECT *, CASE WHEN n % 10 > 1 THEN n || ' bytes, ' || digest END AS caption, CASE WHEN n % 10 = 0 THEN 'unreadable' END AS caption_error FROM images)"""


def make_captioner():
    """An offline model: size and digest; it fails on some images and says nothing about others."""
    from hashlib import md5

    def caption(images):
        return [ValueError("unreadable") if len(i) % 10 == 0 else "  " if len(i) % 10 == 1 else f"{len(i)} bytes, {md5(i).hexdigest()}" for i in images]

    return caption


def captioned(spark: SparkSession, folder: str) -> DataFrame:
    """Whole pages as their own images; every fourth is of a type that is not supported."""
    pages = table(spark, folder, "pages")
    data = F.encode("html", "UTF-8")
    number = F.col("page_id").cast("string")
    files = pages.select(
        "page_id", F.concat(F.lit("a"), number).alias("attachment_id"), F.concat(number, F.lit(".png")).alias("filename"),
        F.when(F.col("page_id") % 4 == 0, "text/plain").otherwise("image/png").alias("media_type"), F.octet_length(data).cast("long").alias("file_size"), data.alias("data"),
    )
    return at.caption_images(at.page_images(pages, files, most=IMAGE_BYTES), make_captioner, most=IMAGE_BYTES)


@query("image_captions", f"WITH {IMAGES_SQL} SELECT page_id, attachment_id, n AS file_size, caption, caption_error FROM captioned")
def image_captions(spark: SparkSession, folder: str) -> DataFrame:
    return captioned(spark, folder).select("page_id", "attachment_id", "file_size", "caption", "caption_error")


@query(
    "image_chunks",
    f"""WITH {IMAGES_SQL}
SELECT page_id || '_att_' || attachment_id AS chunk_id, page_id, md5('Page: ' || coalesce(url, '') || chr(10) || 'Image: ' || filename || chr(10) || chr(10) || caption) AS digest
FROM captioned JOIN pages USING (page_id) WHERE caption IS NOT NULL""",
)
def image_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, their images and the captions as chunks."""
    pages = table(spark, folder, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("title"))
    return caption_chunks(pages, captioned(spark, folder)).select("chunk_id", "page_id", F.md5("content").alias("digest"))


@query(
    "attachment_upsert",
    f"""WITH {IMAGES_SQL}, old AS (
  SELECT 'a' || page_id AS attachment_id, page_id, 'old.png' AS filename, 1::BIGINT AS file_size, 'old' AS caption FROM pages WHERE page_id % 3 = 0)
SELECT attachment_id, page_id, filename, n AS file_size, caption FROM captioned
UNION ALL SELECT * FROM old WHERE attachment_id NOT IN (SELECT attachment_id FROM captioned)""",
)
def attachment_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """New rows take the place of known ones, with their captions or none."""
    pages = table(spark, folder, "pages").where("page_id % 3 = 0")
    old = pages.select(
        F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("attachment_id"), "page_id", F.lit("old.png").alias("filename"),
        F.lit(1).cast("long").alias("file_size"), F.lit("old").alias("caption"),
    )
    return at.upsert_attachments(old, captioned(spark, folder))
