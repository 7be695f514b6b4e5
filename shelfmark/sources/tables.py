"""Parquet tables whose pages can be replaced without rewriting the table.

Rows lie in hash buckets of the page id. A change reads and rewrites only the
buckets of the touched pages, as a new generation, and becomes visible when its
list of buckets is appended to the table's log. A job that dies before that
leaves the old state in place, and running it again gives the same result.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.merge import delete_pages, replace_pages, upsert
from shelfmark.sources.files import path_exists

DEFAULT_BUCKETS = 64
# A reader lists one generation per bucket in its partition filter.
MAX_BUCKETS = 4096


class PageTable:
    """A chunk table (or any table keyed by page) at ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, *, page: str = "page_id",
                 buckets: int = DEFAULT_BUCKETS) -> None:
        if not 0 < buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
        self.spark, self.page, self.schema, self.buckets = spark, page, schema, buckets
        self.rows_path, self.log_path = f"{path}/rows", f"{path}/log"

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.page).cast("string")), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        shape = "generation string, bucket int, batch string"
        if not path_exists(self.spark, self.log_path):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).json(self.log_path)

    def _next_generation(self) -> str:
        """Sorts after every published one; unique, so a dead attempt is never mixed in."""
        last = self._log().agg(F.max("generation")).first()[0]
        number = int(last.split("-")[0]) + 1 if last else 1
        return f"{number:012d}-{uuid.uuid4().hex}"

    def applied(self, batch: str) -> bool:
        """Whether a change with this id was already made (for retried batches)."""
        return bool(self._log().where(F.col("batch") == batch).limit(1).count())

    def _stored(self) -> DataFrame:
        columns = f"{self.schema}, generation string, bucket int"
        if not path_exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(self.rows_path)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows, of some buckets or of all.

        One row of the log per bucket (a bounded number) becomes a filter on
        the partition columns, so other files are not even opened.
        """
        newest = self._log().groupBy("bucket").agg(F.max("generation").alias("generation"))
        if buckets is not None:
            newest = newest.where(F.col("bucket").isin(list(buckets)))
        wanted = [f"{row['generation']}/{row['bucket']}" for row in newest.collect()]
        current = self._stored().where(F.concat_ws("/", "generation", F.col("bucket").cast("string")).isin(wanted))
        return current.drop("generation", "bucket")

    def _publish(self, rows: DataFrame, buckets: list[int], batch: str) -> None:
        generation = self._next_generation()
        placed = rows.withColumn("generation", F.lit(generation)).withColumn("bucket", self._bucket())
        # Rebalancing splits an overfull bucket over several tasks and files.
        (
            placed.hint("rebalance", "bucket")
            .write.mode("append")
            .partitionBy("generation", "bucket")
            .parquet(self.rows_path)
        )
        entries = [(generation, bucket, batch) for bucket in buckets]
        log = self.spark.createDataFrame(entries, "generation string, bucket int, batch string")
        log.coalesce(1).write.mode("append").json(self.log_path)

    def _change(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], batch: str) -> None:
        if batch and self.applied(batch):
            return
        found = touched.select(self._bucket().alias("bucket")).distinct()
        buckets = [row[0] for row in found.collect()]  # at most ``self.buckets`` rows
        if buckets:
            self._publish(change(self.read(buckets)), buckets, batch)

    def replace(self, touched: DataFrame, fresh: DataFrame, batch: str = "") -> None:
        """All rows of the touched pages give way to ``fresh``; an empty page is cleared."""
        self._change(touched, lambda base: replace_pages(base, touched, fresh, self.page), batch)

    def delete(self, gone: DataFrame, batch: str = "") -> None:
        self._change(gone, lambda base: delete_pages(base, gone, self.page), batch)

    def upsert(self, updates: DataFrame, key: str, batch: str = "") -> None:
        """Insert or overwrite rows by key; a row's page must not change."""
        self._change(updates, lambda base: upsert(base, updates, key), batch)

    def truncate(self) -> None:
        self._publish(self._stored().limit(0).drop("generation", "bucket"), list(range(self.buckets)), "")
