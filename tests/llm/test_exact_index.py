"""The index against plain sets; classes of copies on edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from shelfmark.llm.exact_index import CuckooFilter, DigestIndex, apply_changes, digests, exact_dedup, live_groups


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_inserts_deletes_and_resizes():
    rng, index, live = random.Random(1), DigestIndex(), {}
    for step in range(20_000):
        i = rng.randrange(6_000)
        if rng.random() < 0.6:
            index.insert(key(i), 1, 1, i)
            live[i] = live.get(i, 0) + 1
        else:
            assert index.delete(key(i)) == (i in live)
            if i in live:
                live[i] -= 1
                if not live[i]:
                    del live[i]
    assert {k: v[0] for k, v in index.entries.items()} == {key(i): n for i, n in live.items()}
    assert all(index.holds(key(i)) for i in live)
    assert not any(index.holds(key(i)) for i in range(6_000) if i not in live)
    assert (index.filter.mask + 1) > 256


def test_filter_is_right_about_what_is_new():
    found = CuckooFilter(1 << 12)
    assert all(found.insert(key(i)) for i in range(8_000))
    assert all(found.might_hold(key(i)) for i in range(8_000))
    assert sum(found.might_hold(key(i)) for i in range(8_000, 28_000)) < 20
    for i in range(4_000):
        found.delete(key(i))
    assert all(found.might_hold(key(i)) for i in range(4_000, 8_000))


def test_copies(spark):
    rows = [(5, "a b"), (2, "ab"), (3, "ab "), (9, "a\tb\x0b\n"), (None, "c"), (7, "c"), (8, None), (6, ""), (4, " \r\f"), (10, "x"), (10, "x"), (11, "a b")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, keep_id int")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(frame).collect())
    assert got == sorted([
        ("5", "9", 4, False), ("2", "9", 4, False), ("3", "9", 4, False), ("9", "9", 4, True), ("None", "7", 2, False), ("7", "7", 2, True),
        ("8", "4", 3, False), ("6", "4", 3, False), ("4", "4", 3, True), ("10", "10", 2, True), ("10", "10", 2, True), ("11", "11", 1, True),
    ])
    assert exact_dedup(frame.where("false")).count() == 0


def test_changes_to_an_index(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index = live_groups(digests(frame))
    more = digests(spark.createDataFrame([(4, "c"), (0, "a")], "doc_id long, text string")).withColumn("delta", F.lit(1))
    less = digests(spark.createDataFrame([(3, "b"), (9, "z"), (2, "a")], "doc_id long, text string")).withColumn("delta", F.lit(-1))
    changed = apply_changes(index, more.unionByName(less)).collect()
    want = {hashlib.sha256(t.encode()).digest(): v for t, v in {"a": (2, 0), "c": (1, 4)}.items()}
    assert {bytes(r.digest): (r.n, r.row_id) for r in changed} == want
