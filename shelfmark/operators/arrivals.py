"""Rate limiting and duplicate suppression of event arrivals, batch form.

Both carry state from one event of a key to the next. The state is reset by a
long enough pause, so a crowded key is first cut at those pauses and each piece
is scanned on its own (see ``ordered``); the streaming twins in
``shelfmark.streaming`` keep the same state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ordered import cut_hot_keys, ordered_scan

# Keys with more rows than this are cut into pieces first.
HOT_ROWS = 1_000_000


def client_key(subject: Column, address: Column) -> Column:
    """The verified subject, else the address, else one shared bucket."""
    named = F.when(F.length(subject) > 0, F.concat(F.lit("sub:"), subject))
    return F.coalesce(named, F.when(F.length(address) > 0, address), F.lit("unknown"))


class Rate(NamedTuple):
    """A token bucket in whole numbers, so that every way of counting agrees.

    A microsecond adds ``gain`` units; a token is ``token`` units.
    """

    full: int
    token: int
    gain: int

    @classmethod
    def of(cls, burst: float, per_minute: float) -> Rate:
        rate = Fraction(per_minute).limit_denominator(1_000_000)
        token = 60_000_000 * rate.denominator
        return cls(int(Fraction(burst).limit_denominator(1_000_000) * token), token, rate.numerator)

    def refill_micros(self) -> int:
        """The shortest pause after which the bucket is full whatever was in it."""
        return -(-self.full // self.gain)


def take_tokens(
    at: list[int], fresh: list[bool], state: tuple[int, int] | None, rate: Rate
) -> tuple[list[bool], list[int], tuple[int, int] | None]:
    """Token bucket over events in order, at microseconds; returns decisions and waiting times in milliseconds."""
    allowed, wait = [], []
    units, last = state or (rate.full, 0)
    for now, first in zip(at, fresh):
        if first:
            units, last = rate.full, now
        if now > last:
            units, last = min(rate.full, units + (now - last) * rate.gain), now
        if units >= rate.token:
            units -= rate.token
            allowed.append(True)
            wait.append(0)
        else:
            allowed.append(False)
            wait.append(-(-(rate.token - units) // (1000 * rate.gain)))
    return allowed, wait, (units, last)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _times(batch: pa.RecordBatch, at: str) -> list[int]:
    return batch.column(batch.schema.get_field_index(at)).cast(pa.int64()).to_pylist()


def _decided(events: DataFrame, key: str, at: str, tie: str, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows without a time change nothing and get null decisions."""
    rows = events.select(key, at, tie)
    decided = decide(rows.where(F.col(at).isNotNull()))
    added = [F.lit(None).cast(decided.schema[c].dataType).alias(c) for c in decided.columns[3:]]
    return decided.unionByName(rows.where(F.col(at).isNull()).select("*", *added))


def rate_limit(
    events: DataFrame, key: str = "client", at: str = "ts", tie: str = "event_id",
    *, burst: float = 10, per_minute: float = 60, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds allowed and retry_after_ms. A bucket is full again after a pause of burst/rate.

    Null keys share one bucket; an event without a time is undecided (null).
    """
    rate = Rate.of(burst, per_minute)

    def step(batch: pa.RecordBatch, fresh: np.ndarray, state: object) -> tuple[list[pa.Array], object]:
        allowed, wait, state = take_tokens(_times(batch, at), fresh.tolist(), state, rate)
        return [pa.array(allowed), pa.array(wait, pa.int64())], state

    def decide(rows: DataFrame) -> DataFrame:
        pieces = cut_hot_keys(rows, key, at, tie, rate.refill_micros(), hot_rows=hot_rows)
        return ordered_scan(pieces, [key, "segment"], [at, tie], [key, at, tie], step, "allowed boolean, retry_after_ms bigint")

    return _decided(events, key, at, tie, decide)


def accept_after(at: list[int], fresh: list[bool], last: int | None, quiet_micros: int) -> tuple[list[bool], int | None]:
    accepted = []
    for now, first in zip(at, fresh):
        take = first or last is None or now - last > quiet_micros
        if take:
            last = now
        accepted.append(take)
    return accepted, last


def quiet_span(seconds: float) -> int:
    return round(seconds * 1_000_000)


def suppress_duplicates(
    events: DataFrame, key: str, at: str = "ts", tie: str = "event_id", *, quiet_seconds: float,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds accepted: false while an accepted event of the key is still fresh.

    Time stands in for "queued or in progress": a key is accepted again once
    more than ``quiet_seconds`` have passed since it was last accepted. Null
    keys are one key; an event without a time is undecided (null).
    """
    quiet = quiet_span(quiet_seconds)

    def step(batch: pa.RecordBatch, fresh: np.ndarray, state: object) -> tuple[list[pa.Array], object]:
        accepted, state = accept_after(_times(batch, at), fresh.tolist(), state, quiet)
        return [pa.array(accepted)], state

    def decide(rows: DataFrame) -> DataFrame:
        pieces = cut_hot_keys(rows, key, at, tie, quiet, strict=True, hot_rows=hot_rows)
        return ordered_scan(pieces, [key, "segment"], [at, tie], [key, at, tie], step, "accepted boolean")

    return _decided(events, key, at, tie, decide)
