"""The reranker slot: whole lists, failures of one call, ids the model made up."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import rerank as rr


def make_reranker():
    """A model whose class lives in a function, so that it travels to the tasks by value."""

    class Lengths:
        """Scores by length; fails on one query, forgets short texts, makes up an id and repeats one."""

        def __call__(self, query, candidates):
            if query == "bad":
                raise RuntimeError("no luck")
            found = [(i, len(t) / 100) for i, t in candidates if len(t) > 2]
            return [*found, (10**6, 9.0), *[(i, 0.0) for i, _ in found[:1]], *[(i, float("nan")) for i, t in candidates if t == ""]]

    return Lengths


LENGTHS = make_reranker()


def rows(seed=1):
    random_ = random.Random(seed)
    out = []
    for q in range(30):
        name = "bad" if q % 5 == 4 else f"q{q}"
        for place in range(random_.choice([1, 3, 40])):
            out.append((q, place, place + 1, name, "x" * random_.randrange(0, 90) if place != 1 else None))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "query_id long, chunk_id long, rank int, query string, content string").repartition(4)


@pytest.mark.parametrize("list_rows", [1, 7, 256])
def test_every_candidate_has_its_outcome(spark, list_rows):
    data = rows()
    found = {(r.query_id, r.chunk_id): r for r in rr.score_lists(frame(spark, data), LENGTHS, list_rows=list_rows).collect()}
    assert len(found) == len(data)
    for q, c, _, name, text in data:
        r, text = found[q, c], text or ""
        if name == "bad":
            assert (r.outcome, r.error, r.rerank_score) == ("failed", "no luck", None)
        elif len(text) > 2:
            assert (r.outcome, r.error, r.rerank_score) == ("scored", None, round(len(text) / 100, 9))
        else:
            assert (r.outcome, r.error, r.rerank_score) == ("unscored", None, None)


def test_final_order(spark):
    data = rows(2)
    final = rr.rerank_by_model(frame(spark, data), LENGTHS, top_n=5, threshold=0.3)
    got = {}
    for r in final.orderBy("query_id", "final_rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    want = {}
    for q in range(30):
        own = [(c, place, t or "") for owner, c, place, _, t in data if owner == q]
        if q % 5 == 4:
            want[q] = [c for c, _, _ in sorted(own, key=lambda o: o[1])]
        else:
            best = sorted([(-len(t) / 100, c) for c, _, t in own if len(t) > 2])[:5]
            kept = [c for s, c in best if -s >= 0.3]
            if kept:
                want[q] = kept
    assert got == want


def test_counts_and_nothing(spark):
    data = rows()
    counted = rr.outcomes(rr.score_lists(frame(spark, data), LENGTHS)).agg(F.sum("scored") + F.sum("unscored") + F.sum("failed")).first()[0]
    assert counted == len(data)
    assert rr.score_lists(frame(spark, data).limit(0), LENGTHS).collect() == []
