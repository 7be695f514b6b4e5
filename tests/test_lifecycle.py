"""Life cycles in batch, against a plain version, and as a stream with an advancing clock."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.lifecycle import CLAIMS, QUEUE, STALE_CLAIM, Timeout, accepted_arrivals, run_lifecycle
from shelfmark.streaming.lifecycle import lifecycle_stream, with_rocksdb

MINUTE = 60 * 1_000_000


def brute(rows, automaton, timeout=None, until=None):
    out, held = [], {}
    for key, at, tie, event in sorted(rows, key=lambda r: (r[1], r[2])):
        state, last = held.get(key, (automaton.states[0], None))
        if timeout and state == timeout.state and at - last > timeout.micros:
            after, valid = automaton.step(state, timeout.event)
            out.append((key, last + timeout.micros, None, timeout.event, state, after, valid))
            state = after
        after, valid = automaton.step(state, event)
        out.append((key, at, tie, event, state, after, valid))
        held[key] = after, at
    for key, (state, last) in held.items():
        if timeout and state == timeout.state and until - last > timeout.micros:
            out.append((key, last + timeout.micros, None, timeout.event, state, *automaton.step(state, timeout.event)))
    return sorted(out, key=repr)


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "ticket long, us long, id long, event string")
    return raw.select("ticket", F.timestamp_micros("us").alias("ts"), "id", "event")


def rows_of(found):
    return sorted(((r.ticket, r.us, r.id, r.event, r.before, r.after, r.valid) for r in found.withColumn("us", F.unix_micros("ts")).collect()), key=repr)


def events(seed, kinds, n=600, keys=25):
    random_ = random.Random(seed)
    hot = lambda: 3 if random_.random() < 0.4 else random_.randrange(keys)
    return [(hot(), random_.randrange(0, 40 * 3600) * 1_000_000, i, random_.choice(kinds)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_plain(spark, seed):
    queue = events(seed, ["arrival", "arrival", "start", "done"])
    assert rows_of(run_lifecycle(frame(spark, queue), QUEUE, "ticket", "event", "ts", "id")) == brute(queue, QUEUE)
    claims = events(seed, ["claim", "claim", "finish", "fail", "clarify", "clear", "other"])
    until = 41 * 3600 * 1_000_000
    found = run_lifecycle(frame(spark, claims), CLAIMS, "ticket", "event", "ts", "id", timeout=STALE_CLAIM, until="1970-01-02 17:00:00")
    assert rows_of(found) == brute(claims, CLAIMS, STALE_CLAIM, until)


def test_accepted_again_after_completion(spark):
    rows = [(1, 1, 1, "arrival"), (1, 2, 2, "arrival"), (1, 3, 3, "start"), (1, 4, 4, "arrival"), (1, 5, 5, "done"), (1, 6, 6, "arrival")]
    found = accepted_arrivals(run_lifecycle(frame(spark, rows), QUEUE, "ticket", "event", "ts", "id"))
    assert {r.id: r.accepted for r in found.collect()} == {1: True, 2: False, 4: False, 6: True}


def streamed(spark, folder, slices, build):
    """Run the stream once per slice; each run handles what was added and the timers that are due."""
    restore = with_rocksdb(spark)
    try:
        for part in slices:
            part.coalesce(2).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
            query = build(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            assert query.start(f"{folder}/out").awaitTermination(120)
    finally:
        restore()
    return spark.read.parquet(f"{folder}/out")


def test_stream_equals_batch_in_event_time(spark, tmp_path):
    rows = sorted(events(3, ["claim", "claim", "finish", "fail", "clarify", "clear"], n=300), key=lambda r: (r[1], r[2]))
    rows = [(None if r[0] == 4 else r[0], *r[1:]) for r in rows]
    rows.append((None, 60 * 3600 * 1_000_000, 10_000, "tick"))  # moves the clock past every timer
    slices = [frame(spark, rows[:100]), frame(spark, rows[100:200]), frame(spark, rows[200:])]
    found = streamed(
        spark, tmp_path, slices,
        lambda s: lifecycle_stream(s.withWatermark("ts", "0 seconds"), CLAIMS, "ticket", "event", "ts", "id", timeout=STALE_CLAIM),
    )
    assert rows_of(found) == brute(rows, CLAIMS, STALE_CLAIM, 60 * 3600 * 1_000_000)


def test_reclaim_once_by_the_wall_clock(spark, tmp_path):
    """The clock goes on while the stream runs: a claim left alone is handed out again once, a finished one is not."""
    quick = Timeout("in-progress", "reprocess", 2_000_000)
    first = frame(spark, [(1, 1, 1, "claim"), (2, 1, 2, "claim"), (2, 2, 3, "finish"), (3, 1, 4, "finish")])
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    restore = with_rocksdb(spark)
    try:
        moved = lifecycle_stream(
            spark.readStream.schema(first.schema).parquet(f"{tmp_path}/in"), CLAIMS, "ticket", "event", "ts", "id", timeout=quick, clock="processingTime"
        )
        writer = moved.writeStream.format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/state")
        query = writer.trigger(processingTime="1 second").start()

        def reclaimed(wanted):
            for _ in range(60):
                found = [r.ticket for r in spark.table("moved").where("event = 'reprocess'").collect()]
                if len(found) >= wanted:
                    return sorted(found)
                time.sleep(1)
            return sorted(found)

        assert reclaimed(1) == [1]
        frame(spark, [(9, 5, 5, "claim"), (1, 6, 6, "finish")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert reclaimed(2) == [1, 9]
        time.sleep(4)
        query.stop()
        found = spark.table("moved").collect()
    finally:
        restore()
    assert sorted(r.ticket for r in found if r.event == "reprocess") == [1, 9]
    assert sorted((r.ticket, r.valid) for r in found if r.event == "finish") == [(1, False), (2, True), (3, False)]


def test_empty(spark):
    assert rows_of(run_lifecycle(frame(spark, []), CLAIMS, "ticket", "event", "ts", "id", timeout=STALE_CLAIM, until="2020-01-01")) == []
