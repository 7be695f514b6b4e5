"""Attaching vectors: a pluggable batch scorer and an offline default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.spread import spread

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(
    df: DataFrame, text: str, make_embedder: Callable[[], Embedder], *, width: int,
    batch_size: int = 100, name: str = "vector",
) -> DataFrame:
    """Adds vectors from an embedding model, in sub-batches of ``batch_size``.

    ``make_embedder`` runs once per task, so clients and models are built on
    the executor. A result of another width, or of another length than its
    batch, fails the job. Use pure or idempotent models: tasks may be retried.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make_embedder()
        for batch in batches:
            vectors: list = []
            texts = batch[text].tolist()
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                found = list(embedder(part))
                if len(found) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(found)} vectors")
                wrong = [len(v) for v in found if len(v) != width]
                if wrong:
                    raise ValueError(f"vector of width {wrong[0]}, expected {width}")
                vectors.extend(found)
            yield batch.assign(**{name: vectors})

    return df.mapInPandas(run, schema)


_WORD_CACHE = 1 << 17
_SLICE_BYTES = 4 << 20


def hash_bucket(word: str, width: int) -> int:
    """Bucket of a word: the first four hex digits of its MD5, modulo the width."""
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:4], 16) % width


def slices_of(batch: pa.RecordBatch, text: str, most: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most ``most`` bytes of text each, or of a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def hashed_words(
    df: DataFrame, text: str, *, width: int = 64, name: str = "vector", keep_text: bool = True
) -> DataFrame:
    """The offline default: word counts per hash bucket; texts without words give null.

    Select the columns you need beforehand: what passes through Python cannot
    be pruned. ``keep_text=False`` leaves the text itself out of the result.

    Arrow batches are lowered, cut and counted by vectorised calls, a few MiB of
    text at a time, as the words take many times the room of their text; only the
    distinct words of a slice are hashed one by one, and most of them once per task.
    """
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices_of(batch, text):
                yield counted(part, known)

    def counted(batch: pa.RecordBatch, known: dict[str, int]) -> pa.RecordBatch:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        lists = pc.ascii_split_whitespace(pc.utf8_lower(column))
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), pc.list_value_length(lists).to_numpy())
        encoded = lists.flatten().dictionary_encode()
        if len(known) > _WORD_CACHE:
            known.clear()
        buckets = []
        for word in encoded.dictionary.to_pylist():
            bucket = known.get(word)
            if bucket is None:
                bucket = known[word] = hash_bucket(word, width) if word else -1
            buckets.append(bucket)
        bucket = np.array(buckets, dtype=np.int64)[encoded.indices.to_numpy()]
        row, bucket = row[bucket >= 0], bucket[bucket >= 0]
        counts = np.bincount(row * np.int64(width) + bucket, minlength=batch.num_rows * width).astype(np.float32)
        empty = np.bincount(row, minlength=batch.num_rows) == 0
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
        vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts), mask=pa.array(empty))
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, vectors], names=[*kept, name])

    return spread(df).mapInArrow(run, schema)


def hashed_embedder(width: int) -> Embedder:
    """The same vectors for plain lists of texts, to pass to :func:`embed`."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        rows = np.zeros((len(texts), width), dtype=np.float32)
        for place, text in enumerate(texts):
            for word in text.lower().split():
                rows[place, hash_bucket(word, width)] += 1
        return rows.tolist()

    return run


def wrong_width(df: DataFrame, vector: str, width: str | Column) -> DataFrame:
    """Rows whose vector has another width than its profile states."""
    expected = F.col(width) if isinstance(width, str) else width
    return df.where(F.coalesce(F.size(vector), F.lit(-1)) != expected)
