"""Life cycles of tickets: the intake queue and the claims, with moves that aren't allowed reported as rows.

Both are automata over a ticket's events. A timeout stands for a clock: a ticket
that stays in the watched state without any event for too long gets one event
more, and only once, since that event leaves the state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.automaton import Automaton, run_automaton
from shelfmark.operators.ordered import previous_value

#: A ticket waits or is worked on until it is done; arrivals in between are duplicates.
QUEUE = Automaton(("idle", "queued", "in flight"), {("idle", "arrival"): "queued", ("queued", "start"): "in flight", ("in flight", "done"): "idle"})

#: Claims as labels show them. A clarification gives the ticket back, and so does a claim that went stale; a person may clear the result.
CLAIMS = Automaton(
    ("none", "in-progress", "done", "failed"),
    {
        ("none", "claim"): "in-progress", ("in-progress", "finish"): "done", ("in-progress", "fail"): "failed",
        ("in-progress", "clarify"): "none", ("in-progress", "reprocess"): "none", ("done", "clear"): "none", ("failed", "clear"): "none",
    },
)


@dataclass(frozen=True)
class Timeout:
    """``event`` happens to a key that has been in ``state`` for more than ``micros`` without any event."""

    state: str
    event: str
    micros: int


#: A claim without an update for half an hour is stale: it is taken back and handed out again as ``reprocess``.
STALE_CLAIM = Timeout("in-progress", "reprocess", 30 * 60 * 1_000_000)


def with_timeouts(df: DataFrame, timeout: Timeout, key: str, event: str, at: str, tie: str, until: str) -> DataFrame:
    """The events, and a timeout event wherever the next event of the key, or the time ``until``, is too far off.

    Whether the key is in the watched state there is for the automaton to say.
    """
    rows = df.where(F.col(at).isNotNull()).select(key, at, tie, event)
    kind = rows.schema[at].dataType
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(timeout.micros).cast("decimal(18,6)") / 1_000_000)
    # Looking back from each event finds the gap before it; the last event of a key has one up to ``until``.
    linked = previous_value(rows.withColumn("__at", F.col(at).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else F.col(at)), [key], "__at", tie, "__at", "__previous", 86_400)
    gaps = linked.where(F.col("__at") > F.col("__previous") + span).select(key, F.col("__previous").alias("__from"))
    ends = linked.groupBy(key).agg(F.max("__at").alias("__from")).where(F.lit(until).cast("timestamp") > F.col("__from") + span)
    extra = gaps.unionByName(ends).select(
        key, (F.col("__from") + span).cast(kind).alias(at), F.lit(None).cast(rows.schema[tie].dataType).alias(tie), F.lit(timeout.event).alias(event)
    )
    return rows.unionByName(extra)


def run_lifecycle(df: DataFrame, automaton: Automaton, key: str, event: str, at: str, tie: str, *, timeout: Timeout | None = None,
                  until: str | None = None) -> DataFrame:
    """(key, at, tie, event, before, after, valid); timeouts have a null tie and appear only where they move a key.

    Rows without a time are left out where there is a timeout, as nothing places them.
    """
    if timeout is None:
        return run_automaton(df, automaton, key, event, at, tie)
    rows = run_automaton(with_timeouts(df, timeout, key, event, at, tie, until), automaton, key, event, at, tie)
    return rows.where(F.col("valid") | F.col(tie).isNotNull())


def accepted_arrivals(moved: DataFrame, event: str = "event") -> DataFrame:
    """Arrivals with ``accepted``: false while the ticket is queued or in flight."""
    return moved.where(F.col(event) == "arrival").withColumn("accepted", F.col("valid")).drop("before", "after", "valid", event)
