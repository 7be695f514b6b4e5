"""Word search against a plain version, by a pass over the chunks and by the index."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import lexical as lx
from shelfmark.operators.topk import Limits

INDEX = Limits(query_rows=1)


def brute(chunks, queries, k):
    out = set()
    for q, asked in queries:
        if not asked:
            continue
        scored = [(-round(len(set(asked) & set(held)) / len(asked), 9), c) for c, held in chunks if held and set(asked) & set(held)]
        out |= {(q, c, -s, place + 1) for place, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def rows(frame):
    return {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in frame.collect()}


def frames(spark, chunks, queries):
    return (
        spark.createDataFrame(chunks, "chunk_id long, terms array<string>"),
        spark.createDataFrame(queries, "query_id long, terms array<string>"),
    )


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_both_ways_equal_brute_force(spark, seed, k):
    random_ = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]  # a few words are everywhere
    some = lambda most: sorted(set(random_.choices(words, weights, k=random_.randint(0, most))))
    chunks = [(i, some(25)) for i in range(300)] + [(1000 + i, some(25)) for i in range(3)] * 1 + [(2000, None), (2001, [])]
    queries = [(i, some(12)) for i in range(25)] + [(50, ["unknown"]), (51, ["w0"]), (52, ["w0", "unknown"]), (53, None), (54, [])]
    left, right = frames(spark, chunks, queries)
    want = brute(chunks, queries, k)
    assert rows(lx.lexical_hits(left, right, k)) == want
    assert rows(lx.lexical_hits(left, right, k, INDEX)) == want


def test_a_common_word_is_not_joined_in_full(spark):
    """300 queries and 3000 chunks that share a word: the lookups grow with k, not with their product."""
    chunks = [(i, ["common", f"c{i}"]) for i in range(3000)]
    queries = [(i, ["common", f"c{7 * i}"]) for i in range(300)]
    left, right = frames(spark, chunks, queries)
    assert rows(lx.lexical_hits(left, right, 5, INDEX)) == brute(chunks, queries, 5)
    index = lx.postings(left)
    terms = lx.asked_terms(index, right)
    first = lx.counted(left, right, lx.seeds(index, terms, 5))
    ranked = first.withColumn("place", F.row_number().over(lx._best()))
    kth = ranked.where("place = 5").select("query_id", F.col("hits").alias("least"), F.col("chunk_id").alias("last_id"))
    assert first.count() <= 300 * 6
    assert lx.candidates(index, terms, kth).count() <= 300 * 6


def test_empty_sides(spark):
    left, right = frames(spark, [(1, ["a"])], [(1, ["a"])])
    for limits in (Limits(), INDEX):
        assert lx.lexical_hits(left.limit(0), right, 3, limits).count() == 0
        assert lx.lexical_hits(left, right.limit(0), 3, limits).count() == 0
