"""Skew-safe running totals and scans against plain loops."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import arrivals as ar
from shelfmark.operators import conversations as conv
from shelfmark.operators.ordered import previous_value, running_sum


@pytest.fixture(scope="module")
def events():
    random.seed(3)
    rows, now = [], datetime(2024, 1, 1)
    for number in range(3000):
        now += timedelta(milliseconds=random.choice([5, 40, 300, 1500, 9000]))
        key = "hot" if random.random() < 0.4 else f"k{random.randrange(12)}"
        rows.append((number, key, now))
    rows += [(3000 + i, "tie", now) for i in range(5)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "event_id long, client string, ts timestamp").repartition(7).cache()


def by_key(events):
    groups = defaultdict(list)
    for number, key, at in sorted(events, key=lambda e: (e[2], e[0])):
        groups[key].append((number, at))
    return groups


def test_running_sum_with_small_blocks(spark):
    rows = [(k, t, (t * 7) % 5) for k in ("hot", "b") for t in range(500 if k == "hot" else 3)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    for descending in (False, True):
        got = {
            (r["k"], r["t"]): (r["s"], r["s_first"])
            for r in running_sum(df, ["k"], "t", F.col("v"), "s", descending=descending, block=16).collect()
        }
        for key in ("hot", "b"):
            total = 0
            own = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1] if descending else r[1])
            for place, (_, t, v) in enumerate(own):
                total += v
                assert got[(key, t)] == (total, place == 0)


def test_previous_value_across_blocks(frame, events):
    got = {r["event_id"]: r["p"] for r in previous_value(frame, ["client"], "ts", "event_id", "event_id", "p", 5).collect()}
    for rows in by_key(events).values():
        before = None
        for number, _ in rows:
            assert got[number] == before
            before = number


def limit_by_loop(rows, burst, per_minute):
    """Whole-number decisions of one client: (allowed, wait in ms) by event."""
    rate = Fraction(per_minute).limit_denominator(10**6) / 60_000_000  # tokens a microsecond
    tokens, last, out = Fraction(burst), None, {}
    for number, at in rows:
        if at is None:
            out[number] = (None, None)
            continue
        if last is not None and at > last:
            tokens = min(Fraction(burst), tokens + (at - last) // timedelta(microseconds=1) * rate)
        last = at
        allowed = tokens >= 1
        out[number] = (allowed, 0 if allowed else math.ceil((1 - tokens) / rate / 1000))
        tokens -= allowed
    return out


@pytest.mark.parametrize("hot_rows", [50, 10**6])
@pytest.mark.parametrize("burst, per_minute", [(3, 60), (1, 20), (10, 600), (1, 7)])
def test_rate_limit_same_as_a_loop(frame, events, burst, per_minute, hot_rows):
    got = {r["event_id"]: (r["allowed"], r["retry_after_ms"]) for r in ar.rate_limit(frame, burst=burst, per_minute=per_minute, hot_rows=hot_rows).collect()}
    want = {}
    for rows in by_key(events).values():
        want |= limit_by_loop(rows, burst, per_minute)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_decisions_do_not_depend_on_size(spark, seed):
    """Random bursts and rates, pauses at and around the refill time, null keys and null times."""
    rng = random.Random(seed)
    burst, per_minute, quiet = rng.choice([1, 2, 5]), rng.choice([7, 13, 60, 0.5]), rng.choice([1.5, 8.571428])
    refill = ar.Rate.of(burst, per_minute).refill_micros()
    rows, now = [], datetime(2024, 1, 1)
    for number in range(600):
        now += timedelta(microseconds=rng.choice([0, 1, refill - 1, refill, refill + 1, refill // 3, round(quiet * 1e6), round(quiet * 1e6) + 1]))
        rows.append((number, rng.choice(["hot", "hot", "hot", None, "k"]), None if rng.random() < 0.05 else now))
    frame = spark.createDataFrame(rows, "event_id long, client string, ts timestamp").repartition(3)
    limited = [sorted(map(tuple, ar.rate_limit(frame, burst=burst, per_minute=per_minute, hot_rows=n).collect()), key=lambda r: r[2]) for n in (1, 10**6)]
    single = [sorted(map(tuple, ar.suppress_duplicates(frame, "client", quiet_seconds=quiet, hot_rows=n).collect()), key=lambda r: r[2]) for n in (1, 10**6)]
    assert limited[0] == limited[1] and single[0] == single[1] and len(limited[0]) == len(single[0]) == 600
    want = {}
    for key in ("hot", None, "k"):
        want |= limit_by_loop([(n, t) for n, k, t in rows if k == key], burst, per_minute)
    assert {r[2]: r[3:] for r in limited[0]} == want
    assert all((r[1] is None) == (r[3] is None) for r in single[0])


def test_running_sum_keeps_null_keys_and_orders(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 5), (None, 2, 7), (None, 3, 1)], "k string, t long, v long")
    got = sorted((str(r["k"]), str(r["t"]), r["s"], r["s_first"]) for r in running_sum(df, ["k"], "t", F.col("v"), "s", block=2).collect())
    assert got == [("None", "2", 7, True), ("None", "3", 8, False), ("a", "1", 6, True), ("a", "None", 5, False)]


@pytest.mark.parametrize("hot_rows", [50, 10**6])
@pytest.mark.parametrize("quiet", [0.5, 4, 60])
def test_duplicates_same_as_a_loop(frame, events, quiet, hot_rows):
    got = {r["event_id"]: r["accepted"] for r in ar.suppress_duplicates(frame, "client", quiet_seconds=quiet, hot_rows=hot_rows).collect()}
    for rows in by_key(events).values():
        last = None
        for number, at in rows:
            take = last is None or (at - last).total_seconds() > quiet
            last = at if take else last
            assert got[number] == take


def test_hot_key_is_cut_into_segments(frame):
    from shelfmark.operators.ordered import segments_by_gap

    cut = segments_by_gap(frame.where("client = 'hot'"), ["client"], "ts", "event_id", 8_000_000)
    assert cut.select("segment").distinct().count() > 20


def turns(spark, lengths, role="user"):
    rows = [("c", i, role, "x" * n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")


def test_history_budget(spark):
    kept = lambda lengths, n: sorted(r["turn"] for r in conv.history_budget(turns(spark, lengths), n).collect())
    assert kept([200, 200, 6], 55) == [1, 2]
    assert kept([4, 4000], 10) == [1]
    assert kept([4, 4, 4], 100) == [0, 1, 2]
    assert kept([4, 400, 4], 10) == [2]


def test_history_for_model(spark):
    rows = [("a", 0, "system", "s"), ("a", 1, "user", "q"), ("a", 2, "assistant", "r"), ("b", 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    out = sorted(tuple(r) for r in conv.history_for_model(df).collect())
    assert out == [("a", 1, "user", "q"), ("a", 2, "assistant", "r"), ("a", 3, "user", "q"), ("b", 0, "user", "z")]
