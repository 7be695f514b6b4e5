"""Facts about pages in any order lead to one table."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.versions import facts, live_chunks, live_pages, newest
from shelfmark.streaming.lifecycle import replay
from shelfmark.streaming.versions import newest_stream

SHAPE = "kind string, id string, space_key string, at long, payload string"


def made(seed, n=400):
    random_ = random.Random(seed)
    out = []
    for _ in range(n):
        page, at = random_.randrange(30), random_.randrange(100)
        kind = random_.choice(["version", "version", "listed", "deleted"])
        out.append((kind, f"p{page}", f"s{page % 4}", at, f"text {random_.randrange(3)}" if kind == "version" else None))
    out += [("listing", f"s{i}", f"s{i}", at, None) for i in range(3) for at in (20, 60, 85)]
    return out + random_.choices(out, k=100)  # some are delivered twice


def brute(rows):
    best = {}
    for kind, id_, space, at, payload in rows:
        if kind != "version":
            best[kind, id_] = max(best.get((kind, id_), -1), at)
    pages = {}
    for kind, id_, space, at, payload in rows:
        if kind == "version":
            pages.setdefault(id_, []).append((at, space, payload))
    out = {}
    for id_, versions in pages.items():
        at = max(v[0] for v in versions)
        space = versions[0][1]
        head = best.get(("listing", space))
        if best.get(("deleted", id_), -1) >= at or (head is not None and max(at, best.get(("listed", id_), -1)) < head):
            continue
        out[id_] = (space, at, {v[2] for v in versions if v[0] == at})
    return out


def check(found, rows):
    got = {r.page_id: (r.space_key, r.at, r.payload) for r in found.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[p][:2] == want[p][:2] and got[p][2] in want[p][2] for p in got)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    rows = made(seed)
    frame = facts(spark.createDataFrame(rows, SHAPE))
    assert check(live_pages(frame), rows) == check(live_pages(newest(frame)), rows)


def test_stream_in_any_order(spark):
    rows = made(3)
    frame = facts(spark.createDataFrame(rows, SHAPE))
    want = check(live_pages(frame), rows)
    for seed in (1, 2):
        place = F.pmod(F.xxhash64(F.lit(seed), "kind", "id", "at", "mark"), F.lit(3))
        log = replay(frame, place, 3, newest_stream)
        assert check(live_pages(log), rows) == want
        assert log.count() < len(rows)


def test_chunks_of_live_versions(spark):
    rows = [("version", "a", "s", 1, "old"), ("version", "a", "s", 2, "new"), ("version", "b", "s", 1, "b"), ("deleted", "b", "s", 1, None)]
    log = facts(spark.createDataFrame(rows, SHAPE))
    chunks = log.where("kind = 'version'").select(F.col("id").alias("page_id"), "at", "mark", F.explode(F.split("payload", "")).alias("content"))
    assert sorted(r.content for r in live_chunks(chunks, log).collect()) == ["e", "n", "w"]


def test_what_is_no_fact(spark):
    rows = [(None, "a", "s", 1, "x"), ("version", None, "s", 1, "x"), ("version", "a", "s", None, "x"), ("version", "z", None, 5, None)]
    log = facts(spark.createDataFrame(rows, SHAPE))
    assert [tuple(r)[:3] for r in live_pages(log).collect()] == [("z", None, 5)]
    assert live_pages(log.limit(0)).count() == 0


def test_the_state_is_asked_once_and_rows_need_no_frame():
    from pyspark.sql import Row

    from shelfmark.streaming.versions import _Newest

    class Held:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    newest_ = _Newest()
    newest_.held = held = Held()
    some = lambda *pairs: iter([Row(kind="version", id="a", at=at, mark=mark) for at, mark in pairs])
    assert [(r.at, r.mark) for r in newest_.handleInputRows(("version", "a"), some((1, 9), (2, 3), (2, 1)), None)] == [(2, 3)]
    assert list(newest_.handleInputRows(("version", "a"), some((2, 3), (1, 10)), None)) == []
    assert [(r.at, r.mark) for r in newest_.handleInputRows(("version", "a"), some((2, 4)), None)] == [(2, 4)]
    assert held.calls == ["get", "update", "get", "get", "update"]
