"""Cells: recall of the index, exact search with skipped block pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import cells as cl
from shelfmark.operators import retrieval as rt
from shelfmark.operators.topk import Limits, topk

WIDTH = 16


def grouped(rows, groups, seed, noise=0.15):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(groups, WIDTH))
    return centres[random_.integers(0, groups, rows)] + random_.normal(scale=noise, size=(rows, WIDTH))


def frame(spark, rows, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{key} long, vector array<double>")


def rows_of(hits):
    return sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in hits.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    rows = grouped(3000, 30, 1)
    rows[100:160] = rows[7]  # a crowded group of copies
    rows[5] = 0
    return frame(spark, rows, "chunk_id").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = grouped(3000, 30, 1)[:160] + np.random.default_rng(3).normal(scale=0.05, size=(160, WIDTH))
    rows[:40] = grouped(3000, 30, 1)[:40]
    rows[5] = 0
    return frame(spark, rows, "query_id").cache()


def test_codes_are_close(spark, chunks):
    cells = cl.fit_cells(chunks)
    coded = cl.with_cell(chunks, cells.centres, codes=True).collect()
    assert len(coded) == 2999
    for r in coded[:200]:
        unit = np.array(r.vector) / np.linalg.norm(r.vector)
        near = cells.centres[r.cell] + np.frombuffer(r.code, np.int8) * r.scale
        assert np.abs(near - unit).max() <= r.scale and r.cell == (cells.centres @ unit).argmax()


def test_index_reads_few_cells_and_reaches_recall(spark, chunks, queries):
    cells = cl.fit_cells(chunks)
    index = cl.build_index(chunks.withColumn("space", F.lit("s")), cells)
    assert index.count() == 2999 and "space" in index.columns
    exact = topk(chunks, queries, 10)
    found = cl.search_cells(index, cells, queries, 10)
    recall = rt.recall_against(exact, found).agg(F.avg("recall")).first()[0]
    assert recall >= 0.95 and cells.probes < len(cells.centres) / 2
    scores = {(r.query_id, r.chunk_id): r.score for r in topk(chunks, queries, 500).collect()}
    assert all(scores.get((r.query_id, r.chunk_id), r.score) == r.score for r in found.collect())
    one = cl.search_cells(index, cells, queries.where("query_id = 3"), 10, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "") or "cell#" in plan.split("PartitionFilters")[1][:80]


def test_all_cells_give_the_exact_result(spark, chunks, queries):
    cells = cl.fit_cells(chunks, cells=12)
    index = cl.build_index(chunks, cells)
    for options in ({}, {"skip_self": True}, {"threshold": 0.9}):
        want = rows_of(topk(chunks, queries, 5, **options))
        assert rows_of(cl.search_cells(index, cells, queries, 5, probes=len(cells.centres), **options)) == want


def test_index_of_little_or_nothing(spark, chunks, queries):
    for few in (chunks.limit(0), chunks.where("chunk_id = 5"), chunks.where("chunk_id in (5, 6)")):
        cells = cl.fit_cells(few)
        if len(cells.centres):
            assert rows_of(cl.search_cells(cl.build_index(few, cells), cells, queries, 3)) == rows_of(topk(few, queries, 3))
        assert rows_of(topk(few, queries, 3, limits=Limits(query_rows=10))) == rows_of(topk(few, queries, 3))


@pytest.mark.parametrize("options", [{}, {"skip_self": True}, {"threshold": 0.8}])
def test_bounded_blocks_equal_the_scan(spark, chunks, queries, options):
    small = Limits(query_rows=16, corpus_block_rows=100)
    assert rows_of(topk(chunks, queries, 4, limits=small, **options)) == rows_of(topk(chunks, queries, 4, **options))


def test_bounded_blocks_with_scopes(spark, chunks, queries):
    scoped = chunks.withColumn("scope", (F.col("chunk_id") % 3).cast("string"))
    asked = queries.withColumn("scopes", F.when(F.col("query_id") % 4 != 0, F.array((F.col("query_id") % 5).cast("string"))))
    assert rows_of(topk(scoped, asked, 4, limits=Limits(query_rows=16))) == rows_of(topk(scoped, asked, 4))


def test_copies_stay_below_the_number_of_query_blocks(spark, chunks, queries):
    plan = cl.BlockPairs(chunks, queries, 4, block_rows=16, chunk_rows=500, threshold=None)
    first = topk(chunks, queries, 4).withColumn("qb", F.lit(0)).limit(0)
    assert plan.blocks >= 10
    joined = plan.queries.select("query_id", "qb").join(topk(chunks, queries, 4).drop("rank"), "query_id")
    copies = plan.copies(plan.first_pairs()) + plan.copies(plan.later_pairs(joined))
    assert first.count() == 0 and copies < plan.blocks / 2


def test_vectors_without_groups_meet_in_a_plain_grid(spark, monkeypatch):
    """Where the angles spare next to nothing, small cells would send every query to every cell."""
    random_ = np.random.default_rng(5)
    plain = frame(spark, random_.normal(size=(900, WIDTH)), "chunk_id")
    asked = frame(spark, random_.normal(size=(90, WIDTH)), "query_id")
    plan = cl.BlockPairs(plain, asked, 4, block_rows=16, chunk_rows=100, threshold=None)
    assert plan.cost(np.isfinite(plan.bounds)) > plan.grid_cost(256)
    grids, run = [], cl.grid_of_groups
    monkeypatch.setattr(cl, "grid_of_groups", lambda *a: grids.append(a) or run(*a))
    few = Limits(query_rows=16, corpus_block_rows=100)
    assert rows_of(topk(plain, asked, 4, limits=few)) == rows_of(topk(plain, asked, 4)) and len(grids) == 1
