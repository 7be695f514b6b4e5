import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import metrics

def brute(retrieved, relevant, k):
    """The metrics of one ranked list by their definitions, with plain loops."""
    wanted, top = set(relevant), retrieved[:k]
    found = [1 if c in wanted else 0 for c in top]
    best = [1] * min(k, len(wanted))
    gain = lambda flags: sum(f / math.log2(i + 2) for i, f in enumerate(flags))
    places = [i for i, c in enumerate(retrieved) if c in wanted]
    return {
        f"precision_{k}": sum(found) / len(top) if top else 0.0, f"recall_{k}": sum(found) / len(wanted) if wanted else 0.0,
        f"ndcg_{k}": gain(found) / gain(best) if best else 0.0, "rr": 1 / (places[0] + 1) if places else 0.0, "hit_rate": int(bool(places)),
    }


def frames(spark, retrieved, relevant):
    hits = [("q", c, i + 1) for i, c in enumerate(retrieved)]
    pairs = [("q", c) for c in relevant]
    return (
        spark.createDataFrame(hits, "query_id string, chunk_id string, rank int"),
        spark.createDataFrame(pairs, "query_id string, chunk_id string"),
    )


def test_random_lists_equal_plain_loops(spark):
    rng = random.Random(17)
    lists = {q: (rng.sample(range(30), rng.randrange(12)), [rng.randrange(30) for _ in range(rng.randrange(1, 9))]) for q in range(150)}
    hits = [(q, str(c), i + 1) for q, (found, _) in lists.items() for i, c in enumerate(found)]
    pairs = [(q, str(c)) for q, (_, wanted) in lists.items() for c in wanted]
    judged = metrics.judge_pairs(
        spark.createDataFrame(hits, "query_id int, chunk_id string, rank int"), spark.createDataFrame(pairs, "query_id int, chunk_id string")
    )
    ks = [1, 3, 7, 20]
    scores = metrics.per_query(judged, ks)
    rows = {r["query_id"]: r.asDict() for r in scores.collect()}
    assert set(rows) == set(lists)
    sums = {}
    for q, (found, wanted) in lists.items():
        for k in ks:
            for name, value in brute(found, wanted, k).items():
                assert rows[q][name] == pytest.approx(value), (q, name)
                sums.setdefault(name, {})[q] = value
    for r in metrics.aggregate(scores, ks).collect():
        name = {"mrr": "rr"}.get(r["metric"], r["metric"] if r["k"] == 0 else f"{r['metric']}_{r['k']}")
        assert r["value"] == pytest.approx(sum(sums[name].values()) / len(lists)), name


@pytest.mark.parametrize(
    "retrieved, relevant",
    [([], ["m"]), (["m"] , ["m"] * 4), (["p", "q", "m"], ["m"]), (["m", "n"], ["n", "m"]), (["p", "q"], ["m", "n", "o"])],
)
def test_boundaries(spark, retrieved, relevant):
    """Lists shorter than k, repeated relevant ids, nothing found."""
    for k in (1, 2, 9):
        row = metrics.per_query(metrics.judge_pairs(*frames(spark, retrieved, relevant)), [k]).first().asDict()
        for name, value in brute(retrieved, relevant, k).items():
            assert row[name] == pytest.approx(value), (name, k)


def test_a_metric_gone_from_the_run_fails_the_gate(spark):
    shape = "metric string, k long, value double"
    old = spark.createDataFrame([("recall", 5, 0.5), ("mrr", 0, 0.4), ("ndcg", 3, 0.3)], shape)
    new = spark.createDataFrame([("mrr", 0, 0.39), ("ndcg", 3, 0.1), ("hit_rate", 0, 1.0)], shape)
    got = {r["metric"]: (r["value"], r["failed"]) for r in metrics.regressions(new, old, 0.05).collect()}
    assert got == {"recall": (None, True), "mrr": (0.39, False), "ndcg": (0.1, True), "hit_rate": (1.0, False)}


def test_no_queries_give_zeros(spark):
    hits, pairs = frames(spark, [], [])
    means = metrics.aggregate(metrics.per_query(metrics.judge_pairs(hits, pairs), [1]), [1])
    assert {r["value"] for r in means.collect()} == {0.0}


@pytest.mark.parametrize("bad", [[], [0], [-1, 3]])
def test_bad_k_is_an_error(spark, bad):
    with pytest.raises(ValueError, match="k must be positive"):
        metrics.check_k(bad)


def test_all_ties_win_and_nulls_show_a_dash(spark):
    rows = [("a", "mrr", 0, 0.5), ("b", "mrr", 0, 0.5), ("c", "mrr", 0, None), ("d", "mrr", 0, 0.25)]
    tall = spark.createDataFrame(rows, "config string, metric string, k long, value double")
    cells = {r["config"]: (r["is_best"], r["cell"]) for r in metrics.winners(tall).collect()}
    assert cells == {"a": (True, "**0.5000**"), "b": (True, "**0.5000**"), "c": (False, "—"), "d": (False, "0.2500")}


def test_lift(spark):
    tall = spark.createDataFrame([("base", "mrr", 0, 0.5), ("reranked", "mrr", 0, 0.75)], "stage string, metric string, k long, value double")
    assert metrics.lift(tall).first()["lift"] == 0.25


def test_metrics_do_not_depend_on_partitioning(spark):
    hits = spark.range(0, 3000).select(
        (F.col("id") % 100).alias("query_id"), F.col("id").alias("chunk_id"), (F.floor(F.col("id") / 100) + 1).alias("rank")
    )
    pairs = hits.where("chunk_id % 7 = 0").select("query_id", "chunk_id")
    results = [
        metrics.per_query(metrics.judge_pairs(hits.repartition(n), pairs.repartition(n))).orderBy("query_id").collect()
        for n in (1, 4, 16)
    ]
    assert results[0] == results[1] == results[2]
