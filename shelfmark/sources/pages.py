"""Wiki pages as landed JSON: explicit schema, flattened metadata.

Every field is optional and unknown ones are ignored, as a landing zone holds
whatever the wiki returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = (
    "id string, type string, status string, title string, "
    "space struct<key: string, name: string>, "
    "body struct<storage: struct<value: string, representation: string>>, "
    "version struct<number: int, when: string, by: struct<displayName: string>>, "
    "ancestors array<struct<id: string, title: string>>, "
    "metadata struct<labels: struct<results: array<struct<name: string, prefix: string>>>>, "
    "_links struct<webui: string, self: string>"
)
TEXTS = "array<string>"


def read_pages(spark: SparkSession, path: str, space: str | None = None) -> DataFrame:
    """Landed pages; only the columns a query needs are parsed."""
    pages = spark.read.schema(PAGE).json(path)
    return pages.where(F.col("space.key") == space) if space else pages


def stream_pages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).json(path)


def parse_pages(df: DataFrame, column: str) -> DataFrame:
    """Pages held as JSON text in a column."""
    return df.select(F.from_json(column, PAGE).alias("p")).select("p.*")


def _names(list_column: str, field: str) -> Column:
    entries = F.coalesce(F.col(list_column), F.array().cast(f"array<struct<{field}: string>>"))
    return F.array_compact(F.transform(entries, lambda e: e[field]))


def page_metadata(pages: DataFrame, base_url: str = "") -> DataFrame:
    """Flat metadata columns plus ``html``; missing values become empty."""
    empty = F.lit("")
    return pages.select(
        F.col("id").alias("page_id"),
        F.coalesce("title", empty).alias("title"),
        F.coalesce("space.key", empty).alias("space_key"),
        F.coalesce("space.name", empty).alias("space_name"),
        F.coalesce(F.transform("metadata.labels.results", lambda e: e["name"]), F.array().cast(TEXTS)).alias("labels"),
        F.coalesce("version.by.displayName", empty).alias("author"),
        F.coalesce("version.when", empty).alias("last_modified"),
        F.coalesce("version.number", F.lit(1)).alias("version"),
        F.concat(F.lit(base_url), F.coalesce("_links.webui", empty)).alias("url"),
        F.coalesce(F.transform("ancestors", lambda e: e["title"]), F.array().cast(TEXTS)).alias("ancestors"),
        F.coalesce("body.storage.value", empty).alias("html"),
    )


# Column of the chunk table -> key of the exported JSON metadata.
METADATA_KEYS = {
    "space_name": "spaceName",
    "author": "author",
    "last_modified": "lastModified",
    "version": "version",
    "ancestors": "ancestors",
    "chunk_index": "chunkIndex",
    "total_chunks": "totalChunks",
    "header_path": "headerPath",
    "content_type": "contentType",
    "attachment_id": "attachmentId",
}
METADATA_SHAPE = (
    "spaceName string, author string, lastModified string, version int, ancestors array<string>, "
    "chunkIndex bigint, totalChunks bigint, headerPath array<string>, contentType string, attachmentId string"
)


def metadata_to_json(chunks: DataFrame, name: str = "metadata") -> DataFrame:
    """Fold the extra chunk columns into one JSON text with camelCase keys."""
    present = [c for c in METADATA_KEYS if c in chunks.columns]
    packed = F.to_json(F.struct(*[F.col(c).alias(METADATA_KEYS[c]) for c in present]))
    return chunks.select(*[c for c in chunks.columns if c not in present], packed.alias(name))


def metadata_from_json(chunks: DataFrame, name: str = "metadata") -> DataFrame:
    """The reverse: JSON metadata back to columns."""
    parsed = chunks.withColumn("__m", F.from_json(name, METADATA_SHAPE))
    back = [F.col("__m")[key].alias(c) for c, key in METADATA_KEYS.items()]
    return parsed.select(*[c for c in chunks.columns if c != name], *back)
