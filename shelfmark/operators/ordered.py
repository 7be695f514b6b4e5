"""Running totals and ordered scans that survive one key holding most rows.

A plain window puts every row of a key into one task. Here a key's rows are cut
into blocks of their order column; totals are first aggregated per block (with
map-side combine), only the few block rows meet in one window, and the rows
themselves are ordered within their block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = "__block"


def same_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the right side's other columns are added."""
    renamed = right.select(*[F.col(k).alias(f"__right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    equal = [F.col(k).eqNullSafe(F.col(f"__right_{i}")) for i, k in enumerate(keys)]
    condition = equal[0]
    for one in equal[1:]:
        condition = condition & one
    return left.join(renamed, condition, how).drop(*[f"__right_{i}" for i in range(len(keys))])


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    name: str,
    *,
    descending: bool = False,
    block: int = 4096,
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to this row, in the key's order.

    ``order`` is a whole number that is unique within the key. The newest row
    of each key is marked in ``<name>_first``. Rows with a null key form a key
    of their own; rows with a null order come first, or last if descending, and
    are never marked.
    """
    rows = df.withColumn("__value", value).withColumn(
        _BLOCK, F.floor(F.col(order) / F.lit(block)).cast("long")
    )
    edge = F.max if descending else F.min
    totals = rows.groupBy(*keys, _BLOCK).agg(
        F.sum("__value").alias("__total"), edge(order).alias("__edge")
    )
    direction = F.desc if descending else F.asc
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(direction(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        _BLOCK,
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"),
        edge("__edge").over(by_key).alias("__first"),
    )
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        same_key(rows, offsets, [*keys, _BLOCK])
        .withColumn(name, F.col("__before") + F.sum("__value").over(inside))
        .withColumn(f"{name}_first", F.coalesce(F.col(order) == F.col("__first"), F.lit(False)))
        .drop("__value", _BLOCK, "__before", "__first")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: str, tie: str, value: str, name: str, block_seconds: int
) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, in (order, tie) order.

    ``order`` is a timestamp; blocks are time slices.
    """
    rows = df.withColumn(
        _BLOCK, F.floor(F.unix_micros(order) / F.lit(block_seconds * 1_000_000)).cast("long")
    )
    last = rows.groupBy(*keys, _BLOCK).agg(F.max_by(value, F.struct(order, tie)).alias("__last"))
    carried = last.select(
        *keys,
        _BLOCK,
        F.lag("__last").over(Window.partitionBy(*keys).orderBy(_BLOCK)).alias("__carried"),
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order, tie)
    return (
        same_key(rows, carried, [*keys, _BLOCK])
        .withColumn(name, F.coalesce(F.lag(value).over(inside), F.col("__carried")))
        .drop(_BLOCK, "__carried")
    )


def _last_start(df: DataFrame, keys: list[str], order: str, tie: str, block_seconds: int) -> DataFrame:
    """Adds ``segment``: the time of the latest row flagged ``__start`` so far."""
    rows = df.withColumn(
        _BLOCK, F.floor(F.unix_micros(order) / F.lit(block_seconds * 1_000_000)).cast("long")
    ).withColumn("__at", F.when(F.col("__start"), F.col(order)))
    last = rows.groupBy(*keys, _BLOCK).agg(F.max("__at").alias("__last"))
    before = (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = last.select(*keys, _BLOCK, F.max("__last").over(before).alias("__carried"))
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(order, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        same_key(rows, carried, [*keys, _BLOCK])
        .withColumn("segment", F.coalesce(F.max("__at").over(inside), F.col("__carried")))
        .drop(_BLOCK, "__at", "__carried", "__start")
    )


def segments_by_gap(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    gap_micros: int,
    *,
    strict: bool = False,
    block_seconds: int | None = None,
) -> DataFrame:
    """Adds ``segment``: rows of a key belong together until a pause of ``gap_micros``.

    A segment can be worked on alone when such a pause resets the state that is
    carried from row to row, so a hot key is split at every pause. With
    ``strict`` the pause has to be longer than the gap.
    """
    block = block_seconds or max(3600, gap_micros // 1_000_000 * 4)
    linked = previous_value(df, keys, order, tie, order, "__previous", block)
    waited = F.unix_micros(order) - F.unix_micros("__previous")
    limit = F.lit(gap_micros)
    starts = F.col("__previous").isNull() | (waited > limit if strict else waited >= limit)
    return _last_start(
        linked.withColumn("__start", starts).drop("__previous"), keys, order, tie, block
    )


def cut_hot_keys(
    df: DataFrame, key: str, order: str, tie: str, gap_micros: int, *, strict: bool = False,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Adds ``segment`` as :func:`segments_by_gap` does, but only to crowded keys.

    Other keys keep null: one task can scan them whole. There are at most
    total/hot_rows crowded keys, so finding them is one small aggregation. A
    null key is a key like any other.
    """
    crowded = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(key)
    calm = same_key(df, crowded, [key], "left_anti").withColumn("segment", F.lit(None).cast(df.schema[order].dataType))
    hot = segments_by_gap(same_key(df, crowded, [key], "left_semi"), [key], order, tie, gap_micros, strict=strict)
    return calm.unionByName(hot)


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal to each other."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(here, before), False)
    return pc.or_(differs, pc.xor(here.is_null(), before.is_null())).to_numpy(zero_copy_only=False)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    keep: list[str],
    step: Callable[[pa.RecordBatch, np.ndarray, object], tuple[list[pa.Array], object]],
    added: str,
) -> DataFrame:
    """Fold over each key's rows in order; returns ``keep`` and the ``added`` columns.

    Rows are sorted by Spark (which spills). ``step`` gets a batch, a flag per
    row that is true where a new key starts, and the state left by the batch
    before, so no group is ever collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        state: object = None
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            marks = [batch.column(batch.schema.get_field_index(key)) for key in keys]
            fresh = np.zeros(rows, dtype=bool)
            fresh[0] = [mark[0] for mark in marks] != last
            for mark in marks:
                fresh[1:] |= _changes(mark)
            last = [mark[rows - 1] for mark in marks]
            new, state = step(batch, fresh, state)
            kept = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=names)

    out = T.StructType([*[df.schema[name] for name in keep], *T.StructType.fromDDL(added).fields])
    names = out.fieldNames()
    placed = df.select(*dict.fromkeys([*keys, *order, *keep])).repartition(*[F.col(key) for key in keys])
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, out)
