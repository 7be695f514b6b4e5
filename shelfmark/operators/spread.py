"""Row layout helpers: using all cores on small inputs, exploding costly arrays, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import ensure_checkpoint_dir

SMALL_BYTES = 1 << 30
#: Stored bytes of input whose rows one task of a join of narrow rows gets; they take many times that in memory.
JOIN_BYTES, MOST_PARTS = 2 << 20, 8192


def input_bytes(df: DataFrame) -> int:
    """Size of everything a frame reads, by Spark's own estimates; runs nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """Deal the rows of a small input out to all cores before heavy per-row work.

    A small file is one partition and would keep one core busy. Larger inputs
    have enough partitions and are returned as they are, unshuffled.
    """
    if input_bytes(df) > most_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def join_parts(*frames: DataFrame) -> int:
    """Partitions for a join of narrow rows, by the size of what the largest frame reads; runs nothing.

    Narrow rows are packed so well in a shuffle that partitions joined by their
    shuffled size get millions of rows, which one task would sort.
    """
    least = frames[0].sparkSession.sparkContext.defaultParallelism
    return max(least, min(MOST_PARTS, max(map(input_bytes, frames)) // JOIN_BYTES))


def explode_once(df: DataFrame, keep: Sequence[str], items: Column, place: str, value: str) -> DataFrame:
    """Rows (keep..., place, value) of an array that is costly to compute.

    A plain explode makes Spark filter on the array's size first, which
    computes it again, below any exchange. The outer form does not.
    """
    staged = df.select(*keep, items.alias("__items"))
    rows = staged.select(*keep, F.posexplode_outer("__items").alias(place, value))
    return rows.where(F.col(place).isNotNull())


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; it goes when the session's file system closes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfmark-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The frame written as a table in the shared checkpoint folder and read back, so that what uses it repeats nothing before it.

    ``by`` are partition columns; a filter on them skips the other folders.
    """
    path = f"{scratch_folder(df.sparkSession)}/rows"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    fields = [f for f in df.schema.fields if f.name not in by] + [df.schema[name] for name in by]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
