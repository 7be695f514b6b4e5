"""Stateful twins of the batch operators in ``operators.arrivals``.

State is two whole numbers per key. It is forgotten once no event of the key has
arrived for ``idle``, which bounds the stored keys by the active ones; ``idle``
is at least the pause that resets the state. The watermark is on the time of
arrival, so no event is dropped: a late one is counted when it arrives, at the
latest time seen so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.operators.arrivals import Rate, accept_after, micros, quiet_span, take_tokens

ARRIVED = "__arrived"


def _ordered(parts: Iterator[pd.DataFrame], at: str, tie: str) -> pd.DataFrame:
    """Rows of one key in one micro-batch; ``maxFilesPerTrigger`` bounds them."""
    return pd.concat(list(parts)).sort_values([at, tie])


def _flags(rows: int, first: bool) -> list[bool]:
    return [first] + [False] * (rows - 1)


def _stateful(
    events: DataFrame, key: str, at: str, tie: str, added: str, held: str, idle_ms: int,
    decide: Callable[[list[int], object], tuple[list[list], tuple]],
) -> DataFrame:
    """Fold ``decide`` over each key's timed rows; rows without a time get null decisions."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {tie} {kinds[tie]}, {added}"
    names = [column.split()[0] for column in added.split(", ")]

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = _ordered(parts, at, tie)
        timed, untimed = rows[rows[at].notna()], rows[rows[at].isna()]
        if len(untimed):
            yield untimed[[key, at, tie]].assign(**{c: None for c in names})
        if len(timed):
            columns, now = decide(micros(timed[at]), now)
            yield timed[[key, at, tie]].assign(**dict(zip(names, columns, strict=True)))
        if now is not None:
            state.update(now)
            arrived = int(rows[ARRIVED].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(arrived, state.getCurrentWatermarkMs()) + max(1, idle_ms))

    arriving = events.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, "1 minute")
    return arriving.groupBy(key).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(events: DataFrame, key: str = "client", at: str = "ts", tie: str = "event_id",
                      *, burst: float = 10, per_minute: float = 60, idle: int = 86_400_000) -> DataFrame:
    """Adds allowed and retry_after_ms; ``idle`` is in milliseconds."""
    rate = Rate.of(burst, per_minute)

    def decide(times: list[int], held: object) -> tuple[list[list], tuple]:
        allowed, wait, new = take_tokens(times, _flags(len(times), held is None), held, rate)
        return [allowed, wait], new

    forget = max(idle, rate.refill_micros() // 1000 + 1)
    return _stateful(events, key, at, tie, "allowed boolean, retry_after_ms bigint", "units long, last long", forget, decide)


def suppress_duplicates_stream(events: DataFrame, key: str, at: str = "ts", tie: str = "event_id",
                               *, quiet_seconds: float, idle: int = 86_400_000) -> DataFrame:
    """Adds accepted: false while an accepted event of the key is still fresh."""
    quiet = quiet_span(quiet_seconds)

    def decide(times: list[int], held: object) -> tuple[list[list], tuple]:
        accepted, last = accept_after(times, _flags(len(times), held is None), held[0] if held else None, quiet)
        return [accepted], (last,)

    return _stateful(events, key, at, tie, "accepted boolean", "last long", max(idle, quiet // 1000 + 1), decide)
