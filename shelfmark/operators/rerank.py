"""The reranker slot: a model that sees a query with its candidates and returns scored ids.

Rows are dealt out and sorted by query, so a task holds one call's candidates at
a time. A query with more candidates than ``list_rows`` is asked about in
several lists, each as long as the bound allows, in the order of the first
stage; its lists may go to different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.operators.ordered import _changes
from shelfmark.operators.retrieval import rerank_or_base
from shelfmark.operators.topk import SCORE_DECIMALS

#: Gets the query and (chunk_id, content) of its candidates; returns (chunk_id, score) of those it found worth scoring.
Reranker = Callable[[str, Sequence[tuple[object, str]]], Sequence[tuple[object, float]]]
LIST_ROWS = 256


def score_lists(candidates: DataFrame, make_reranker: Callable[[], Reranker], *, by: str = "query_id", query: str = "query",
                content: str = "content", list_rows: int = LIST_ROWS) -> DataFrame:
    """The candidates without their texts, with ``rerank_score``, ``error`` and ``outcome``.

    ``make_reranker`` runs once per task, and tasks may be repeated. An exception
    fails every candidate of its call and no other. Ids that are not among the
    call's candidates are dropped, and the first score of an id counts; a
    candidate that is not returned, or without a number, has no score. Null
    texts are empty. ``outcome`` is scored, unscored or failed. ``candidates``
    has chunk_id and rank.
    """
    kept = [f for f in candidates.schema.fields if f.name not in (query, content)]
    out = T.StructType([*kept, *T.StructType.fromDDL("rerank_score double, error string, outcome string").fields])
    schema, names = to_arrow_schema(out), [f.name for f in kept]
    part = F.floor((F.col("rank") - 1) / list_rows).cast("long")
    rows = candidates.withColumn("__list", part).select(*names, query, content, "__list")

    def ask(reranker: Reranker, table: pa.Table) -> pa.Table:
        ids = table.column("chunk_id").to_pylist()
        texts = [t or "" for t in table.column(content).to_pylist()]
        scores: dict[object, float] = {}
        error = None
        try:
            for found, score in reranker(table.column(query)[0].as_py() or "", list(zip(ids, texts, strict=True))):
                if score is not None and np.isfinite(score):
                    scores.setdefault(found, round(float(score), SCORE_DECIMALS))
        except Exception as problem:  # the call's candidates carry it
            scores, error = {}, str(problem) or type(problem).__name__
        states = ["failed" if error else "scored" if i in scores else "unscored" for i in ids]
        new = [pa.array([scores.get(i) for i in ids], pa.float64()), pa.array([error] * len(ids), pa.string()), pa.array(states)]
        return pa.table([c.cast(f.type) for c, f in zip([*[table.column(n) for n in names], *new], schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reranker, held, key = make_reranker(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            owners, lists = batch.column(batch.schema.get_field_index(by)), batch.column(batch.schema.get_field_index("__list"))
            starts = np.flatnonzero(np.concatenate([[True], _changes(owners) | _changes(lists)]))
            for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = (owners[start].as_py(), lists[start].as_py())
                if held and here != key:
                    yield from ask(reranker, pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(start, stop - start))
                key = here
        if held:
            yield from ask(reranker, pa.Table.from_batches(held)).to_batches()

    return rows.repartition(by, "__list").sortWithinPartitions(by, "__list", "rank").mapInArrow(run, out)


def rerank_by_model(candidates: DataFrame, make_reranker: Callable[[], Reranker], *, by: str = "query_id", query: str = "query", content: str = "content",
                    top_n: int = 10, threshold: float = 0.0, list_rows: int = LIST_ROWS) -> DataFrame:
    """Final order of a model's scores: its best ``top_n`` that reach the threshold, or the first order where a call failed."""
    scored = score_lists(candidates, make_reranker, by=by, query=query, content=content, list_rows=list_rows)
    return rerank_or_base(scored, by=(by,), top_n=top_n, threshold=threshold)


def outcomes(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, scored, unscored, failed): how many candidates of a query the model answered for."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return scored.groupBy(by).agg(count("scored"), count("unscored"), count("failed"))
