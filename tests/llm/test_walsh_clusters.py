"""Transform, search and clusters against plain versions in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from shelfmark.llm.walsh_clusters import LONG, SAFE, WIDTH, Centroids, clustered, nearest, restored, transformed


def whole(x):
    return int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)


def brute(rows, k, rounds):
    kept = [
        (i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == WIDTH and all(x is not None and math.isfinite(x) for x in v)
    ]
    mark = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: mark(r[0]))][:k]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (which, _) in zip(kept, found, strict=True) if which == c]
            if own:
                centroids[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assign()
    per = {c: sum(d for which, d in found if which == c) for c in range(len(centroids))}
    total = sum(per.values())
    held = lambda n: n if n <= LONG else None
    return [
        (i, c, held(d), held(per[c]), held(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, found, strict=True)
    ]


def same(frame, want):
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))


def cloud(n, seed=1):
    random_ = random.Random(seed)
    centres = [[random_.uniform(-1, 1) for _ in range(WIDTH)] for _ in range(6)]
    return [(i, [x + random_.gauss(0, 0.1) for x in random_.choice(centres)]) for i in range(n)]


def test_transform_is_exact():
    x = np.random.default_rng(1).integers(-SAFE + 1, SAFE, (50, WIDTH))
    c = transformed(x)
    assert (restored(c) == x).all()
    assert ((c * c).sum(1) == WIDTH * (x * x).sum(1)).all()
    assert (transformed(x.astype(object)) == c).all()
    assert (c[:, 0] == x.sum(1)).all()


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_equals_brute_force_with_ties(kind):
    random_ = np.random.default_rng(2)
    x, c = random_.integers(-3, 4, (300, WIDTH)), random_.integers(-3, 4, (40, WIDTH))
    c[30], c[7], x[:40] = c[3], c[3], c
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    which, least = nearest(transformed(x.astype(kind)), transformed(c.astype(kind)))
    assert which.tolist() == far.argmin(1).tolist() and least.tolist() == far.min(1).tolist()


def test_large_centroids_only_where_they_matter():
    random_ = random.Random(3)
    centroids = [[random_.randint(-500, 500) for _ in range(WIDTH)] for _ in range(5)] + [[SAFE + 3] * WIDTH, [10**40] + [0] * 63, [SAFE] + [0] * 63]
    vectors = [[random_.randint(-500, 500) for _ in range(WIDTH)] for _ in range(50)] + [[SAFE - 1] * WIDTH, [SAFE - 1] + [0] * 63]
    far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in vectors]
    which, least = Centroids(centroids).nearest(transformed(np.array(vectors)))
    assert which.tolist() == [f.index(min(f)) for f in far] and [int(d) for d in least] == [min(f) for f in far]


def test_clusters_equal_brute_force(spark):
    rows = cloud(300)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    same(clustered(frame), brute(rows, 40, 5))
    same(clustered(frame, k=3, rounds=2), brute(rows, 3, 2))


def test_edge_cases(spark):
    good = cloud(12, 4)
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None] + [0.5] * 63), (105, [math.nan] * 64), (106, [math.inf] + [0.0] * 63)]
    rows = good + good[:3] + [(None, good[0][1]), (None, good[0][1])] + bad
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, coefficients int")
    same(clustered(frame), brute(rows, 40, 5))  # fewer rows than centroids
    same(clustered(frame, k=4), brute(rows, 4, 5))
    assert clustered(frame.where("vec_id >= 100")).collect() == [] and clustered(frame.limit(0)).collect() == []


def test_components_of_any_size(spark):
    rows = cloud(20, 5) + [(50, [1e30] + [0.25] * 63), (51, [1e30] * 64), (52, [-1e300] + [1.5] * 63), (53, [70000.3] * 64), (54, [-0.001] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k in (2, 6, 25):
        same(clustered(frame, k=k), brute(rows, k, 5))


def test_table_of_floats(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    same(clustered(frame), brute(rows, 40, 5))
