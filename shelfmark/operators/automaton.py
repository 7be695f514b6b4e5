"""A finite automaton over each key's events in order, for keys of any size.

Rows are dealt out by ranges of (key, time, tie), so a crowded key lies in
several partitions. What a run of events does is a table from state to state,
and tables of neighbouring runs combine, so every partition works at once: where
a key began in an earlier partition its rows keep the outcome for each state it
may be in. One small row per partition then says which state that was.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.operators.ordered import _changes
from shelfmark.operators.spread import stored


@dataclass(frozen=True)
class Automaton:
    """States, the first of which every key starts in, and the moves (state, event) -> state; nothing else is a valid move."""

    states: tuple[str, ...]
    moves: Mapping[tuple[str, str], str]

    def events(self) -> list[str]:
        return sorted({event for _, event in self.moves})

    def table(self) -> np.ndarray:
        """Events x states -> state; the last row is for events that no move knows."""
        code = {state: i for i, state in enumerate(self.states)}
        return np.array([[code[self.moves.get((s, e), s)] for s in self.states] for e in [*self.events(), None]], np.uint8)

    def after(self, before: Column, event: Column) -> Column:
        """The state after an event; the same state where the move isn't valid."""
        found = before
        for (state, name), target in self.moves.items():
            found = F.when((before == state) & (event == name), F.lit(target)).otherwise(found)
        return found

    def valid(self, before: Column, event: Column) -> Column:
        found = F.lit(False)
        for state, name in self.moves:
            found = found | ((before == state) & (event == name))
        return F.coalesce(found, F.lit(False))

    def step(self, state: str, event: str) -> tuple[str, bool]:
        """One move in plain Python, for the streaming form."""
        return self.moves.get((state, event), state), (state, event) in self.moves


def run_tables(tables: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every row, what all rows from the start of its run up to it do together.

    ``tables`` has a state table per row, ``starts`` the place where its run begins.
    """
    found, rows, step = tables.copy(), np.arange(len(tables)), 1
    while step < len(tables):
        later = rows[rows - step >= starts]
        if not len(later):
            break
        found[later] = np.take_along_axis(found[later], found[later - step], axis=1)
        step *= 2
    return found


_LETTER = 97


def run_automaton(df: DataFrame, automaton: Automaton, key: str, event: str, at: str, tie: str) -> DataFrame:
    """(key, at, tie, event, before, after, valid) of every row, in order of (at, tie) within its key.

    An event that is no move of the state before it changes nothing and is not
    valid. Null keys are one key; rows without a time come first.
    """
    size, known, moves = len(automaton.states), automaton.events(), automaton.table()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, at, tie, event)
    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part int, first boolean, outcomes string, finally string").fields])
    schema = to_arrow_schema(out)

    def letters(codes: np.ndarray) -> list[str]:
        text = (codes + _LETTER).tobytes().decode()
        return [text[i : i + codes.shape[1]] for i in range(0, len(text), codes.shape[1])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first_key, carry = TaskContext.get().partitionId(), None, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0)
            fresh = np.concatenate([[last is None or last[0] != keys[0].as_py()], _changes(keys)])
            starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            kinds = batch.column(3).dictionary_encode()
            codes = np.array([known.index(e) if e in known else len(known) for e in [*kinds.dictionary.to_pylist(), None]])
            place = kinds.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)
            done = run_tables(moves[codes[place]], starts)
            if not fresh[0]:  # the run goes on from the batch before
                run = np.flatnonzero(starts == 0)
                done[run] = done[run][:, carry]
            before = np.empty_like(done)
            before[1:] = done[:-1]
            before[fresh] = np.arange(size, dtype=np.uint8)
            if not fresh[0]:
                before[0] = carry
            is_open = (np.cumsum(fresh) == int(last is None)) & first_key
            first_key = bool(is_open.all())
            outcomes = [o if f else o[0] for o, f in zip(letters(before), is_open, strict=True)]
            ends = [o if f else o[0] for o, f in zip(letters(done), is_open, strict=True)]
            last, carry = (keys[n - 1].as_py(),), done[-1].copy()
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(is_open), pa.array(outcomes), pa.array(ends)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    dealt = rows.repartitionByRange(parts, key, at, tie).sortWithinPartitions(key, at, tie)
    scanned = stored(dealt.mapInArrow(scan, out))
    begins = _beginnings(scanned, automaton, key, at, tie)
    small = df.sparkSession.createDataFrame(begins or [(-1, 0)], "part int, begin int")
    placed = scanned.join(F.broadcast(small), "part", "left")
    code = F.ascii(F.when(F.col("first"), F.expr("substring(outcomes, begin + 1, 1)")).otherwise(F.col("outcomes")))
    before = F.element_at(F.array(*map(F.lit, automaton.states)), code - (_LETTER - 1))
    found = placed.select(key, at, tie, event, before.alias("before"))
    return found.select("*", automaton.after(F.col("before"), F.col(event)).alias("after"), automaton.valid(F.col("before"), F.col(event)).alias("valid"))


def _beginnings(scanned: DataFrame, automaton: Automaton, key: str, at: str, tie: str) -> list[tuple[int, int]]:
    """(part, state code) in which each partition's first key begins; reads one row per partition."""
    edge = F.struct(F.col(key).isNotNull(), F.col(key), F.col(at).isNotNull(), F.col(at), F.col(tie))
    ends = scanned.groupBy("part").agg(F.max_by(F.struct(key, "first", "finally"), edge).alias("last"), F.min_by(F.struct(F.col(key).alias("k")), edge).alias("head"))
    begins, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        state = before[1] if before is not None and before[0] == (r.head.k,) else 0
        begins.append((r.part, state))
        outcome = r.last["finally"]
        before = (r.last[key],), ord(outcome[state] if r.last["first"] else outcome[0]) - _LETTER
    return begins
