"""Classes against a brute-force comparison of all pairs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import near_dedup
from shelfmark.llm.common import KEY, buffers
from shelfmark.llm.near_dedup import deduplicated, near_duplicates
from shelfmark.llm.words import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingle_counts(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return Counter()
    return Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def brute(rows):
    """Smallest id of every row's class, over all pairs of distinct texts."""
    sets = [shingle_counts(t) for _, t in rows]
    every = sorted({s for c in sets for s in c})
    _, hashes = near_dedup.shingles(*words(*buffers(pa.array([" ".join(s) for s in every]))))
    cell = dict(zip(every, (hashes % (1 << near_dedup.SPACE_BITS)).tolist(), strict=True))
    df, n = Counter(x for c in sets for x in {cell[s] for s in c}), len(rows)
    idf = {s: 1 + math.log((n + 1) / (df[cell[s]] + 1)) / math.log(n + 1) for s in every}
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    close = 1.0
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not a or not b:
                continue
            low = sum(min(a[s], b[s]) * idf[s] for s in a.keys() & b.keys())
            high = sum(max(a[s], b[s]) * idf[s] for s in a.keys() | b.keys())
            close = min(close, abs(low / high - 0.8))
            if low / high >= 0.8:
                up[root(i)] = root(j)
    best = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        best[root(i)].append(doc)
    return {rows[i][0]: min(best[root(i)]) for i in range(len(rows))}, close


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows + ["", None, "...", "one two", "One, two!", "one two three"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["__sm_doc"]: r for r in near_duplicates(frame).collect()}
    want, _ = brute(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_crowded_bucket_takes_rounds(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


@pytest.mark.parametrize("far", [False, True])
def test_pairs_unlike_their_only_leader(spark, far):
    """Two texts similar only by a shingle that both have more often than the leader; then also with samples unlike the leader's."""
    base, run = [f"v{i}" for i in range(1000)], ["q"] * 35
    texts = [" ".join([*base, *["q"] * 5])] + [" ".join([*base[:800], *run, *[f"n{k}{i}" for i in range(80)]]) for k in range(2)]
    names = spark.range(3).select(F.concat(F.lit("v"), "id").cast("binary").alias("v")).orderBy(F.xxhash64("v")).collect()
    drawn = [np.arange(near_dedup.SAMPLES, dtype=np.uint32) for _ in texts]
    if far:  # one bucket in common, and the first sample of every band for the two
        drawn[0][2:] += 100
        for k in (1, 2):
            drawn[k][3::2] += 1000 * k
    rows = [(bytes(n.v), i, i, t, d.tobytes()) for i, (n, t, d) in enumerate(zip(names, texts, drawn, strict=True))]
    frame = spark.createDataFrame(rows, "vertex binary, i long, h long, __sm_text string, samples binary")
    key = [F.col("i").alias(KEY[0]), F.col("h").alias(KEY[1])]
    idf = spark.sparkContext.broadcast(np.ones(1 << near_dedup.SPACE_BITS, np.float32))
    got = near_dedup._classes(frame.select("vertex", F.struct(*key).alias("k"), "samples"), frame.select(*key, "__sm_text"), idf, 0.8)
    classes = {bytes(r.vertex): bytes(r["class"]) for r in got.collect()}
    least = min(rows[1][0], rows[2][0])
    assert classes.pop(rows[0][0], rows[0][0]) == rows[0][0] and classes == {rows[1][0]: least, rows[2][0]: least}


def test_members_that_differ_from_an_edited_leader_alike(spark, monkeypatch):
    """Where the leader is an edited copy itself, all others share what it lost; only pairs that can be similar are compared."""
    rng = random.Random(5)
    base, rows = [f"v{i}" for i in range(160)], []
    for _ in range(130):
        copy = list(base)
        for at in rng.sample(range(160), 4):
            copy[at] = f"n{rng.randrange(10**9)}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows + [f"{rows[i]} tail" for i in (3, 50)]))
    real, pairs = near_dedup._verified, []

    def counted(found, *args, **more):
        pairs.append(found.count())
        return real(found, *args, **more)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    got = {r["__sm_doc"]: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)[0] and len(set(got.values())) > 100
    assert sum(pairs) < 131 * 130 / 4


def test_rows_dealt_by_bucket_or_mark_are_narrow(spark, monkeypatch):
    """The many rows of which most are alone under their bucket or mark carry neither samples nor what is known of a member."""
    rng = random.Random(6)
    base, rows = [f"v{i}" for i in range(160)], []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(160), 4):
            copy[at] = f"n{rng.randrange(10**9)}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows + [f"{rows[i]} tail" for i in (3, 20)]))
    real, columns, by_mark = near_dedup.stored, [], []

    def kept(df):
        columns.append(set(df.columns))
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        by_mark.extend("".join(lines[i : i + 4]) for i, line in enumerate(lines) if "Exchange hashpartitioning(mark#" in line)
        return real(df)

    monkeypatch.setattr(near_dedup, "stored", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["__sm_doc"]: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows)[0]
    assert not any(x >= {"bucket", "n", "samples"} for x in columns)
    counted = [x for x in by_mark if "more#" in x]
    assert counted and not any("common#" in x for x in counted)


def test_marks_count_excess(spark):
    """Shingles that both texts have more often than the leader are marks, all of them."""
    rows = [(b"a", " ".join(["x"] * 20)), (b"b", " ".join(["x"] * 9)), (b"c", " ".join(f"v{i}" for i in range(90)))]
    texts = spark.createDataFrame(rows, "vertex binary, __sm_text string")
    idf = spark.sparkContext.broadcast(np.ones(1 << near_dedup.SPACE_BITS, np.float32))
    pairs = spark.createDataFrame([(b"a", b"b"), (b"b", b"c")], "a binary, b binary")
    got = {bytes(r.a): r for r in near_dedup._verified(pairs, texts, idf, marked=True).collect()}
    assert (len(got[b"a"].only_a), len(got[b"a"].only_b)) == (1, 0)
    assert (len(got[b"b"].only_a), len(got[b"b"].only_b)) == (1, 86)
    assert got[b"a"].more_a == [11.0] and got[b"b"].more_a == [5.0] and got[b"b"].more_b == [1.0] * 86


def test_filter_nulls_repeats_and_clashes(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text, 0), (2, text.upper(), 0), (None, text, 0), (None, None, 0), (3, None, 0), (4, "", 0), (5, "x y", 0), (5, "x y", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    kept = deduplicated(frame)
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted((str(r.doc_id), r.text) for r in kept.where("text is not null").collect()) == [("1", text), ("4", ""), ("5", "x y"), ("5", "x y")]
    assert kept.where("text is null").count() == 2
    assert deduplicated(frame.where("false")).count() == 0


def test_one_of_the_copies_without_an_id_stays(spark):
    rows = [(None, "a b c d e f g")] * 3 + [(None, "...")] * 2 + [(None, None)] * 2 + [(None, "h i j k l m"), (7, "h i j k l m")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in deduplicated(frame).collect()) == [("7", "h i j k l m"), ("None", "..."), ("None", "None"), ("None", "a b c d e f g")]
    assert near_duplicates(frame).where("kept").count() == 4


def test_samples_agree_as_often_as_the_sets(monkeypatch):
    rng = np.random.default_rng(0)
    names = np.sort(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    first, second = rng.uniform(1, 3, 800).astype(np.float32), rng.uniform(1, 3, 800).astype(np.float32)
    second[:700] = first[100:]
    share = np.minimum(first[100:], second[:700]).sum()
    want = share / (first.sum() + second.sum() - share)
    agree = []
    for seed in range(40):
        monkeypatch.setattr(near_dedup, "_SEEDS", np.random.default_rng(seed).integers(1, 1 << 63, (near_dedup.SAMPLES + 2, 2), dtype=np.uint64))
        a = near_dedup.samples(np.zeros(800, int), names[:800], first, 1)
        b = near_dedup.samples(np.zeros(800, int), names[100:], second, 1)
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - want) < 0.04
