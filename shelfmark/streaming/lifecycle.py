"""Life cycles of keys in a stream: the automaton of ``operators.automaton`` as keyed state, with timers.

State is one name and one time per key. A timeout is an event of its own: a key
that stays in the watched state without any event for too long gets it once, as
a row of the result, and moves on as the automaton says. With ``eventTime`` the
watermark is the clock; with ``processingTime`` it is the wall clock, and then
the time of a key's last event is when it was handled.

A micro-batch's rows of one key are put in order by (at, tie) before they are
handled, so the trigger's limit (``maxFilesPerTrigger``) bounds what is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.automaton import Automaton
from shelfmark.operators.lifecycle import Timeout
from shelfmark.operators.spread import scratch_folder

KEY = "__key"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LifeCycle(StatefulProcessor):
    def __init__(self, automaton: Automaton, timeout: Timeout | None, names: tuple[str, str, str, str], by_event_time: bool):
        self.automaton, self.timeout, self.by_event_time = automaton, timeout, by_event_time
        self.key, self.at, self.tie, self.event = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, last long")

    def _row(self, key: object, micros: int, tie: object, event: str | None, state: str) -> tuple[tuple, str]:
        after, valid = self.automaton.step(state, event)
        return (key, micros, tie, event, state, after, valid), after

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=[self.key, self.at, self.tie, self.event, "before", "after", "valid"])
        found[self.at] = pd.to_datetime(found[self.at], unit="us")
        found[self.tie] = found[self.tie].astype("Int64")
        return found

    def _watch(self, state: str, last: int, now_ms: int) -> None:
        """One timer per key, for as long as it is in the watched state."""
        if not self.timeout:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state == self.timeout.state:
            due = (last + self.timeout.micros) // 1000 + 1 if self.by_event_time else now_ms + self.timeout.micros // 1000
            self.handle.registerTimer(max(due, now_ms + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = self.held.get() if self.held.exists() else (self.automaton.states[0], None)
        now_ms = 0
        if self.timeout:
            now_ms = int(timerValues.getCurrentWatermarkInMs() if self.by_event_time else timerValues.getCurrentProcessingTimeInMs())
        arrived = pd.concat(list(rows)).sort_values([self.at, self.tie])
        found = []
        times = arrived[self.at].astype("datetime64[us]").astype("int64").tolist()
        for micros, tie, event in zip(times, arrived[self.tie].tolist(), arrived[self.event].tolist(), strict=True):
            late = self.timeout and self.by_event_time and state == self.timeout.state and last is not None and micros > last + self.timeout.micros
            if late:  # the clock had not come this far yet
                row, state = self._row(key[0], last + self.timeout.micros, None, self.timeout.event, state)
                found.append(row)
            row, state = self._row(key[0], micros, tie, event, state)
            found.append(row)
            last = micros if last is None else max(last, micros)
        self.held.update((state, last))
        self._watch(state, last, now_ms)
        yield self._frame(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last = self.held.get() if self.held.exists() else (self.automaton.states[0], None)
        if self.timeout is None or state != self.timeout.state:
            return
        due = last + self.timeout.micros if self.by_event_time else int(expiredTimerInfo.getExpiryTimeInMs()) * 1000
        row, state = self._row(key[0], due, None, self.timeout.event, state)
        self.held.update((state, last))
        yield self._frame([row])

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, automaton: Automaton, key: str, event: str, at: str, tie: str, *,
                     timeout: Timeout | None = None, clock: str = "eventTime") -> DataFrame:
    """The rows of ``run_lifecycle`` as a stream: key, at, tie, event, before, after, valid.

    ``events`` needs a watermark on ``at`` for the clock ``eventTime``, and a
    session whose state store is RocksDB (see ``with_rocksdb``). Keys are whole
    numbers or text; null keys are one key. Rows without a time can't be placed
    and are left out.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    out = T.StructType([T.StructField(KEY, T.StringType())] + [T.StructField(c, kinds[c]) for c in (at, tie, event)] + T.StructType.fromDDL("before string, after string, valid boolean").fields)
    processor = _LifeCycle(automaton, timeout, (KEY, at, tie, event), clock == "eventTime")
    # State under a null key is not kept apart from other keys', so keys are text that is never null.
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    placed = events.where(F.col(at).isNotNull()).select(named.alias(KEY), at, tie, event)
    mode = clock[0].upper() + clock[1:] if timeout else "None"
    moved = placed.groupBy(KEY).transformWithStateInPandas(processor, out, "Append", mode)
    back = F.when(F.col(KEY) != "", F.expr(f"substring({KEY}, 2)")).cast(kinds[key]).alias(key)
    return moved.select(back, at, tie, event, "before", "after", "valid")


def time_slice(rows: DataFrame, at: str, slices: int) -> Column:
    """The number of each row's slice, of equal spans of time."""
    ends = rows.agg(F.min(F.unix_micros(at)).alias("least"), F.max(F.unix_micros(at)).alias("most")).first()
    step = max(1, -(-((ends.most or 0) - (ends.least or 0) + 1) // slices))
    return F.floor((F.unix_micros(at) - F.lit(ends.least or 0)) / step)


def replay(rows: DataFrame, place: Column, slices: int, build: Callable[[DataFrame], DataFrame], last: DataFrame | None = None) -> DataFrame:
    """Land the rows slice by slice (``place`` is 0 and up), run the stream after each, and read what it wrote; ``last`` lands with the last.

    For checks and for filling a new table from a log: the same stream as live,
    with the state kept from run to run.
    """
    spark, folder = rows.sparkSession, scratch_folder(rows.sparkSession)
    restore = with_rocksdb(spark)
    try:
        for i in range(slices):
            part = rows.where(place == i)
            part = part.unionByName(last) if last is not None and i == slices - 1 else part
            part.write.mode("append").parquet(f"{folder}/in")
            moved = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            writer = moved.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            writer.start(f"{folder}/out").awaitTermination()
    finally:
        restore()
    return spark.read.schema(moved.schema).parquet(f"{folder}/out")


def with_rocksdb(spark: SparkSession) -> Callable[[], None]:
    """Use the state store that timers need; the returned function restores the setting."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    return lambda: spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
