"""The automaton against a plain fold, with crowded keys over many partitions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.operators.automaton import Automaton, run_automaton, run_tables

LAMP = Automaton(("off", "on", "broken"), {("off", "press"): "on", ("on", "press"): "off", ("on", "hit"): "broken", ("broken", "mend"): "off"})


def brute(rows):
    out, state = [], defaultdict(lambda: "off")
    for key, at, tie, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        after, valid = LAMP.step(state[key], event)
        out.append((key, at, tie, event, state[key], after, valid))
        state[key] = after
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "ticket long, at long, tie long, event string").repartition(5)
    return sorted(map(tuple, run_automaton(frame, LAMP, "ticket", "event", "at", "tie").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_plain_fold(spark, seed):
    random_ = random.Random(seed)
    events = ["press", "press", "hit", "mend", "other", None]
    key = lambda: random_.choice([7] * 6 + [None, *range(40)])  # noqa: E731  # half of the rows have one key
    rows = [(key(), random_.choice([None, *range(60)]), i, random_.choice(events)) for i in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_one_key_and_no_rows(spark):
    rows = [(1, i, 0, random.Random(i).choice(["press", "hit", "mend"])) for i in range(3000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_crowded_key_is_spread(spark):
    frame = spark.range(20_000).selectExpr("1L AS ticket", "id AS at", "id AS tie", "'press' AS event")
    found = run_automaton(frame, LAMP, "ticket", "event", "at", "tie")
    assert found.where("valid").count() == 20_000 and found.where("before = 'on'").count() == 10_000
    sizes = frame.repartitionByRange(8, "ticket", "at", "tie").rdd.glom().map(len).collect()
    assert max(sizes) < 20_000 / 4


def test_tables_combine():
    tables = np.array([[1, 0, 2], [1, 2, 2], [0, 0, 1], [2, 1, 0]], np.uint8)
    found = run_tables(tables, np.array([0, 0, 0, 3]))
    for i, start in enumerate([0, 0, 0, 3]):
        for state in range(3):
            here = state
            for j in range(start, i + 1):
                here = tables[j][here]
            assert found[i][state] == here
