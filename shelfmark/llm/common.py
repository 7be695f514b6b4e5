"""Helpers shared by the corpus operators.

Rows are addressed by two internal columns, ``__sm_id`` and ``__sm_h``: the id
with nulls folded to 0, and a hash of the text and of the id being null. Both
are never null, so keyed joins keep every row. Rows that repeat id and text are
the same key; each operator says what that means for them. Operators select
only the columns they name, so further columns of any name do no harm.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import ensure_checkpoint_dir

KEY = ["__sm_id", "__sm_h"]
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The two key columns; see the module's text."""
    found = F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(KEY[0])
    return [found, F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))).alias(KEY[1])]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, __sm_text): texts under their keys; a null text is empty."""
    return docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("__sm_text"))


def stored(df: DataFrame) -> DataFrame:
    """The frame written as a table in the shared checkpoint folder and read back.

    Later steps read the files, so a lost executor repeats nothing before them.
    The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfmark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def drawn(rows: DataFrame, most: int, by: list[str]) -> DataFrame:
    """At most ``most`` rows, one for each value of ``by``, those whose hash is least.

    A bound on the hash, from the number of values, leaves about half as many
    again as are wanted before anything is sorted, at any size of the table.
    """
    mark = F.xxhash64(*by)
    values = rows.agg(F.approx_count_distinct(mark)).first()[0]
    rows = rows.withColumn("__sm_mark", mark)
    if values > 2 * most:
        rows = rows.where(F.col("__sm_mark") < -(1 << 63) + (1 << 64) * 3 * most // (2 * values))
    return rows.dropDuplicates(["__sm_mark"]).orderBy("__sm_mark").limit(most).drop("__sm_mark")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column, without a copy per row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[cuts[0] : cuts[-1]], cuts - cuts[0]


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of at most about ``most`` bytes from here on, unless the session has a lower bound already.

    The session's bound is 64 MiB by default, which a task holds several times over: as it fills, as it is sent, and in
    Python. Rows, their order and their values stay the same.
    """
    found = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
    if found <= 0 or found > most:
        spark.conf.set(BATCH_CONF, str(most))


_KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What this process keeps between tasks of one operator; what it has kept for another operator goes.

    Spark uses a worker again for the stages that follow, whose memory the tables of an operator before would add to.
    """
    others = [name for name in _KEPT if name != operator]
    for name in others:
        del _KEPT[name]
    if others:
        gc.collect()
    return _KEPT.setdefault(operator, {})


def frugal(operator: str, run: Task) -> Task:
    """``run`` for the tasks of an operator, in a worker that holds no other operator's tables and gives back what it has freed.

    Idle workers stay beside the stages that follow, and allocators would keep a task's freed arrays for them.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for(operator)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return whole


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
