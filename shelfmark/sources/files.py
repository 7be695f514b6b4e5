"""Local text files and image attachments through Spark's binary file source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators.filters import MAX_ATTACHMENT_BYTES, eligible_attachment

TEXT_EXTENSIONS = (".md", ".txt", ".html")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return bool(files.exists(target))


def full_path(spark: SparkSession, path: str) -> str:
    files, target = _file_system(spark, path)
    return files.makeQualified(target).toString().rstrip("/")


def extension_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r".(\.[^.]*)\z", 1))


def stem_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def scan_files(spark: SparkSession, folder: str, extensions: Sequence[str] = TEXT_EXTENSIONS) -> DataFrame:
    """Matching files below a folder; a missing folder gives no rows.

    Contents are read only when ``content`` is used later on.
    """
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    wanted = [e.lower() for e in extensions]
    if path_exists(spark, folder):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        root = full_path(spark, folder)
    else:
        files, root = spark.createDataFrame([], shape), folder
    relative = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    return files.select(
        F.col("path").alias("file_path"),
        relative.alias("relative_path"),
        stem_of(F.col("path")).alias("file_name"),
        extension_of(F.col("path")).alias("extension"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    ).where(F.col("extension").isin(wanted))


def file_pages(files: DataFrame) -> DataFrame:
    """Files as pages of the space ``local``, converted to HTML by extension."""
    body = F.decode(F.col("content"), "UTF-8")
    html = (
        F.when(F.col("extension") == ".html", body)
        .when(F.col("extension") == ".md", tx.markdown_to_html(body))
        .otherwise(tx.text_to_html(body))
    )
    return files.select(
        tx.local_page_id(F.col("relative_path")).alias("page_id"),
        F.col("file_name").alias("title"),
        F.lit("local").alias("space_key"),
        F.lit("Local Files").alias("space_name"),
        F.array().cast("array<string>").alias("labels"),
        F.lit("local").alias("author"),
        F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_modified"),
        F.lit(1).alias("version"),
        F.col("file_path").alias("url"),
        tx.path_ancestors(F.col("relative_path")).alias("ancestors"),
        html.alias("html"),
    )


def read_attachments(
    spark: SparkSession, folder: str, listing: DataFrame, most: int = MAX_ATTACHMENT_BYTES
) -> DataFrame:
    """Listed attachments (with ``file_path``) joined to their bytes.

    The size filter is on the file's real length, so larger files are never
    opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .where(F.col("length") <= most)
        .select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"), F.col("content").alias("data"))
    )
    joined = listing.join(files, "file_path")
    return joined.where(eligible_attachment(F.col("media_type"), F.col("file_size"), F.col("n_bytes"), most))
