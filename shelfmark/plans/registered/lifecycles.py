"""Life cycles of tickets, in batch and as a replayed stream: a conversation is a ticket, its turns are what happened to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.automaton import Automaton
from shelfmark.operators.lifecycle import CLAIMS, QUEUE, Timeout, accepted_arrivals, run_lifecycle
from shelfmark.plans.registered import query, table
from shelfmark.streaming.lifecycle import lifecycle_stream, replay, time_slice

# The length of a turn's text decides what happened, and moves the time a little.
QUEUE_EVENTS = ("arrival", "arrival", "start", "done", "start", "done")
CLAIM_EVENTS = ("claim", "claim", "finish", "fail", "clear", "clarify")
STALE = Timeout("in-progress", "reprocess", 40 * 60_000_000)
UNTIL = "2031-01-01 00:00:00"
SLICES = 3


def events(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    size = F.coalesce(F.length("text"), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, names)), size % len(names) + 1)
    seconds = F.col("turn") * 1800 + size * 7 % 3000
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("ticket"), kind.alias("event"), F.timestamp_seconds(seconds).alias("ts"), F.col("turn").alias("event_id")
    )


def walk_sql(automaton: Automaton, names: tuple[str, ...], timeout: Timeout | None = None) -> str:
    """Every event with the state before and after it, one event of each ticket per step; ``expired`` where a timeout came first."""
    after = " ".join(f"WHEN '{state}/{event}' THEN '{target}'" for (state, event), target in automaton.moves.items())
    moved = lambda state: f"CASE {state} || '/' || p.event {after} ELSE {state} END"
    late = f"w.after = '{timeout.state}' AND p.us - w.us > {timeout.micros}" if timeout else "false"
    reset = automaton.moves[(timeout.state, timeout.event)] if timeout else ""
    before = f"CASE WHEN {late} THEN '{reset}' ELSE w.after END"
    return f"""placed AS (
  SELECT conv_id AS ticket, turn AS event_id, (turn * 1800 + size * 7 % 3000) * 1000000 AS us, {list(names)}[size % {len(names)} + 1] AS event,
         row_number() OVER (PARTITION BY conv_id ORDER BY us, turn) AS n
  FROM (SELECT *, coalesce(length(text), 0) AS size FROM conversations)),
walk AS (
  SELECT ticket, n, us, event_id, event, '{automaton.states[0]}' AS before, {moved(f"'{automaton.states[0]}'")} AS after,
         false AS expired, us AS last FROM placed p WHERE n = 1
  UNION ALL
  SELECT p.ticket, p.n, p.us, p.event_id, p.event, {before}, {moved(f"({before})")}, {late}, w.us
  FROM walk w JOIN placed p ON p.ticket = w.ticket AND p.n = w.n + 1)"""


def valid_sql(automaton: Automaton) -> str:
    return "before || '/' || event IN (" + ", ".join(f"'{state}/{event}'" for state, event in automaton.moves) + ")"


QUEUE_SQL = f"""WITH RECURSIVE {walk_sql(QUEUE, QUEUE_EVENTS)}
SELECT ticket, event_id, {valid_sql(QUEUE)} AS accepted FROM walk WHERE event = 'arrival'"""

CLAIMS_SQL = f"""WITH RECURSIVE {walk_sql(CLAIMS, CLAIM_EVENTS, STALE)},
ends AS (SELECT ticket, max(n) AS n FROM walk GROUP BY ticket)
SELECT ticket, us, event_id, event, before, after, {valid_sql(CLAIMS)} AS valid FROM walk
UNION ALL
SELECT ticket, last + {STALE.micros}, NULL, '{STALE.event}', '{STALE.state}', 'none', true FROM walk WHERE expired
UNION ALL
SELECT ticket, us + {STALE.micros}, NULL, '{STALE.event}', '{STALE.state}', 'none', true
FROM walk JOIN ends USING (ticket, n) WHERE after = '{STALE.state}'"""


def _queue(moved: DataFrame) -> DataFrame:
    return accepted_arrivals(moved).select("ticket", "event_id", "accepted")


@query("queue_arrivals", QUEUE_SQL)
def queue_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A ticket is accepted again after its completion; arrivals before that are duplicates."""
    return _queue(run_lifecycle(events(spark, folder, QUEUE_EVENTS), QUEUE, "ticket", "event", "ts", "event_id"))


@query("queue_arrivals_stream", QUEUE_SQL)
def queue_arrivals_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same decisions by a stream that keeps each ticket's state between its runs."""
    rows = events(spark, folder, QUEUE_EVENTS)
    return _queue(replay(rows, time_slice(rows, "ts", SLICES), SLICES, lambda s: lifecycle_stream(s, QUEUE, "ticket", "event", "ts", "event_id")))


def _claims(moved: DataFrame) -> DataFrame:
    return moved.select("ticket", F.unix_micros("ts").alias("us"), "event_id", "event", "before", "after", "valid")


@query("claim_moves", CLAIMS_SQL)
def claim_moves(spark: SparkSession, folder: str) -> DataFrame:
    """States around every event, moves that aren't allowed marked, and stale claims handed out again."""
    rows = events(spark, folder, CLAIM_EVENTS)
    return _claims(run_lifecycle(rows, CLAIMS, "ticket", "event", "ts", "event_id", timeout=STALE, until=UNTIL))


@query("claim_moves_stream", CLAIMS_SQL)
def claim_moves_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same by a stream; one more row at the end moves its clock past the last timer."""
    rows = events(spark, folder, CLAIM_EVENTS)
    tick = rows.limit(1).select(F.lit(None).cast("long").alias("ticket"), F.lit("tick").alias("event"), F.lit(UNTIL).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"))

    def build(source: DataFrame) -> DataFrame:
        return lifecycle_stream(source.withWatermark("ts", "0 seconds"), CLAIMS, "ticket", "event", "ts", "event_id", timeout=STALE)

    landed = replay(rows, time_slice(rows, "ts", SLICES), SLICES, build, last=tick)
    return _claims(landed.where(F.col("event") != "tick"))
