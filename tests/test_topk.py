import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import retrieval as rt
from shelfmark.operators.topk import Limits, grid_of_groups, grid_rows_for, score_topk, topk

DIM = 8


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(400, DIM)).round(2)
    rows[200:260] = rows[0]  # a large group of exact copies
    rows[300] = 0  # no direction, so no score
    return rows


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(i, [float(x) for x in v], f"S{i % 3}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<double>, scope string").cache()


@pytest.fixture(scope="module")
def asked(spark, vectors):
    rows = [(i, [float(x) for x in vectors[i]]) for i in range(40)]
    return spark.createDataFrame(rows, "query_id long, vector array<double>").cache()


def brute(vectors, k, threshold=None, skip_self=False, allowed=None):
    expected = set()
    norms = np.linalg.norm(vectors, axis=1)
    for q in range(40):
        scored = []
        for c in range(len(vectors)):
            if norms[c] == 0 or (skip_self and c == q) or (allowed and c % 3 not in allowed(q)):
                continue
            score = round(float(vectors[q] @ vectors[c] / (norms[q] * norms[c])), 9)
            if threshold is None or score >= threshold:
                scored.append((-score, c))
        expected |= {(q, c, r + 1) for r, (_, c) in enumerate(sorted(scored)[:k])}
    return expected


def found(df):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_same_as_brute_force_on_any_partitioning(corpus, asked, vectors, partitions):
    assert found(topk(corpus.repartition(partitions), asked, 5)) == brute(vectors, 5)


def test_threshold_and_self(corpus, asked, vectors):
    hits = topk(corpus, asked, 7, threshold=0.5, skip_self=True)
    assert found(hits) == brute(vectors, 7, 0.5, True)


def test_block_against_block_gives_the_same(corpus, asked, vectors):
    small = Limits(query_rows=9, corpus_block_rows=70)
    assert found(topk(corpus, asked, 5, threshold=0.1, limits=small)) == brute(vectors, 5, 0.1)
    tight = Limits(query_bytes=2000)
    assert found(topk(corpus, asked, 5, limits=tight)) == brute(vectors, 5)


def test_scopes(corpus, asked, vectors):
    scoped = asked.withColumn(
        "scopes", F.when(F.col("query_id") < 10, F.array(F.lit("S0"))).when(F.col("query_id") < 20, F.array(F.lit("S1"), F.lit("S2")))
    )
    allowed = lambda q: {0} if q < 10 else {1, 2} if q < 20 else {0, 1, 2}
    assert found(topk(corpus, scoped, 4)) == brute(vectors, 4, allowed=allowed)
    assert found(topk(corpus, scoped, 4, limits=Limits(query_rows=6, corpus_block_rows=90))) == brute(vectors, 4, allowed=allowed)


def test_each_task_emits_few_rows(corpus, asked):
    assert score_topk(corpus.coalesce(1), asked, 3).count() == 40 * 3


def test_bad_k_and_mixed_widths(spark, corpus, asked):
    with pytest.raises(ValueError, match="k must be positive"):
        topk(corpus, asked, 0)
    mixed = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, vector array<double>")
    with pytest.raises(Exception, match="different widths"):
        topk(mixed, asked, 1).collect()


def test_no_queries(spark, corpus, asked):
    assert topk(corpus, asked.limit(0), 3).count() == 0


def test_lexical_scores(spark):
    chunks = spark.createDataFrame(
        [("a", ["x", "y"]), ("b", ["y", "z"]), ("c", ["w"]), ("d", [])], "chunk_id string, terms array<string>"
    )
    queries = spark.createDataFrame([("q", ["x", "y", "u"]), ("r", ["w"]), ("s", ["none"])], "query_id string, terms array<string>")
    rows = {(r["query_id"], r["chunk_id"]): round(r["score"], 3) for r in topk(chunks, queries, 5, field="terms").collect()}
    assert rows == {("q", "a"): 0.667, ("q", "b"): 0.333, ("r", "c"): 1.0}


def test_rerank_takes_the_best_first_and_the_threshold_second(spark):
    rows = [("q", c, i + 1, s) for i, (c, s) in enumerate([("a", 0.1), ("b", 0.9), ("c", 0.5), ("d", 0.2)])]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, s double")
    kept = rt.rerank(hits, F.col("s"), top_n=3, threshold=0.3).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in kept] == ["b", "c"]
    stray = spark.createDataFrame([("q", "zzz")], "query_id string, chunk_id string")
    assert rt.keep_known(stray, hits).count() == 0


def test_failed_rerank_keeps_the_first_order_and_empty_stays_empty(spark):
    rows = [
        ("q", "a", 1, 0.1, None), ("q", "b", 2, None, "boom"),
        ("r", "a", 1, 0.1, None), ("r", "b", 2, 0.9, None),
        ("s", "a", 1, 0.1, None),
    ]
    scored = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, rerank_score double, error string")
    out = rt.rerank_or_base(scored, threshold=0.5).orderBy("query_id", "final_rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in out] == [("q", "a"), ("q", "b"), ("r", "b")]


def test_limit_of_the_search_tool():
    assert rt.check_limit(50) == 50
    for bad in (0, 51):
        with pytest.raises(ValueError):
            rt.check_limit(bad)


def test_carried_columns_belong_to_their_hits(corpus, asked):
    few = Limits(query_rows=9, corpus_block_rows=70)
    for limits in (Limits(), few):
        hits = topk(corpus.repartition(5), asked, 6, carry=("scope",), limits=limits).collect()
        assert len(hits) == 40 * 6 and all(h["scope"] == f"S{h['chunk_id'] % 3}" for h in hits)


def test_prefix_widths_in_one_pass(spark, corpus, asked):
    """The same queries at two widths, against a search for each."""
    probes = asked.select("query_id", F.explode(F.array(F.lit(3), F.lit(DIM))).alias("width"), "vector").select(
        F.concat_ws("/", "width", "query_id").alias("query_id"), F.struct("vector", "width").alias("probe")
    )
    chunks = corpus.select("chunk_id", F.col("vector").alias("probe"))
    found = topk(chunks, probes, 6, field="probe", threshold=0.1)
    for width in (3, DIM):
        cut = lambda df, key: df.select(key, F.slice("vector", 1, width).alias("vector"))
        want = {(f"{width}/{r.query_id}", r.chunk_id, r.score, r["rank"]) for r in topk(cut(corpus, "chunk_id"), cut(asked, "query_id"), 6, threshold=0.1).collect()}
        assert {tuple(r) for r in found.where(F.col("query_id").startswith(f"{width}/")).collect()} == want


def test_a_grid_brings_together_the_pairs_of_a_group_and_no_others(spark):
    from pyspark.sql import types as T

    chunks = spark.range(300).select(F.col("id").alias("chunk_id"), (F.col("id") % 3).alias("g"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), (F.col("id") % 4).alias("g"))
    out = T.StructType.fromDDL("chunk_id long, query_id long")

    def meet(part, block):
        import pyarrow as pa

        assert part.num_rows <= 40 and block.num_rows <= 40
        pairs = [(c, q) for c in part.column("chunk_id").to_pylist() for q in block.column("query_id").to_pylist()]
        return pa.table({"chunk_id": [c for c, _ in pairs], "query_id": [q for _, q in pairs]}, schema=pa.schema({"chunk_id": pa.int64(), "query_id": pa.int64()}))

    found = grid_of_groups(chunks, asked, "g", meet, out, 20)
    assert sorted(map(tuple, found.collect())) == sorted((c, q) for c in range(300) for q in range(50) if c % 3 == q % 4)
    assert grid_rows_for(10**12, 10, 1000) == 1000 and grid_rows_for(10**6, 10, 1000) == 111


def test_copies_of_the_best_row_in_any_order(spark):
    """Rows wait before they are put among the best; the least ids win among equals however late they come."""
    from shelfmark.operators.topk import BestRows, Scored

    ids = np.random.default_rng(2).permutation(500)
    scores = np.round(np.random.default_rng(3).random((500, 6)), 1)
    best = BestRows(6, 3)
    for start in range(0, 500, 20):
        part = scores[start : start + 20]
        best.offer(Scored(part.copy(), 1e-9, lambda r, q, p=part: p[r, q]), np.arange(6), pa.array(ids[start : start + 20]), [], 0.2)
    table = best.table(pa.array(range(6)), pa.schema({"query_id": pa.int64(), "chunk_id": pa.int64(), "score": pa.float64()}))
    want = {(q, int(i), float(s)) for q in range(6) for s, i in sorted(zip(-scores[:, q], ids))[:3] for s in [-s]}
    assert {tuple(r.values()) for r in table.to_pylist()} == want


def test_a_null_among_the_scopes_opens_nothing(corpus, asked, vectors):
    some = corpus.withColumn("scope", F.when(F.col("chunk_id") % 3 != 2, F.col("scope")))
    scoped = asked.withColumn("scopes", F.array(F.lit("S0"), F.lit(None).cast("string")))
    want = brute(vectors, 4, allowed=lambda q: {0})
    assert found(topk(some, scoped, 4)) == want
    assert found(topk(some, scoped, 4, limits=Limits(query_rows=6, corpus_block_rows=90))) == want
