"""Golden sets as JSON lines: numbered reading with errors per line, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.golden import check_golden_lines


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with file and 1-based line number, without one task per file.

    A line's place inside its split is free; the number of lines in the splits
    before it comes from a small count per file and split.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__id"),
    )
    counts = raw.groupBy("file", "__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "__split", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = raw.join(offsets, ["file", "__split"])
    return joined.select("file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_number"), "line")


class GoldenSetError(ValueError):
    """A golden set that cannot be used, with the first offending line."""


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Valid cases of a golden set; any bad line or an empty set is an error."""
    checked = check_golden_lines(read_numbered_lines(spark, path))
    summary = checked.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("line_number", "problem"))).alias("bad"),
    ).first()
    if summary["bad"]:
        raise GoldenSetError(f"{path} line {summary['bad'][0]}: {summary['bad'][1]}")
    if summary["n"] == 0:
        raise GoldenSetError(f"{path}: the set is empty")
    return checked.select("query_id", "query", "relevant_chunk_ids")


def relevant_pairs(cases: DataFrame) -> DataFrame:
    return cases.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))


def write_golden(records: DataFrame, path: str) -> None:
    """Write JSON lines. The output committer publishes all files or none."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
