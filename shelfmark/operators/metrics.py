"""Ranking metrics over many queries and configurations at once.

Judged rows carry the grouping columns plus
  rank      position of a retrieved chunk, null for rows that only count relevance
  relevant  whether the retrieved chunk is relevant
  n_rel     what the row adds to the query's number of relevant chunks
so one aggregation per query, with map-side combine, gives every metric at
every k. A query without hits still has its relevance rows and counts as zero.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fixed

DEFAULT_K = (1, 3, 5, 10)


def check_k(k_values: Sequence[int]) -> list[int]:
    if not k_values or any(k <= 0 for k in k_values):
        raise ValueError(f"k must be positive, got {list(k_values)}")
    return sorted(set(k_values))


def judge_pairs(hits: DataFrame, relevant: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Judge hits against explicit (query_id, chunk_id) pairs; duplicates count once.

    Both sides are reduced to one row per pair by a single aggregation, so a
    query with very many relevant chunks is spread over all tasks.
    """
    keys = [*by, "chunk_id"]
    found = hits.select(*keys, F.col("rank").cast("long").alias("rank"), F.lit(False).alias("relevant"))
    wanted = relevant.select(*keys, F.lit(None).cast("long").alias("rank"), F.lit(True).alias("relevant"))
    pairs = found.unionByName(wanted).groupBy(*keys).agg(
        F.min("rank").alias("rank"), F.max("relevant").alias("relevant")
    )
    return pairs.select(*by, "rank", "relevant", F.col("relevant").cast("long").alias("n_rel"))


def judge_classes(
    hits: DataFrame, cases: DataFrame, by: Sequence[str] = ("query_id",)
) -> DataFrame:
    """Judge hits that carry their own ``relevant`` flag.

    ``cases`` has the grouping columns and ``n_rel``, the number of relevant
    chunks; use it where relevance is a shared class instead of listed pairs.
    """
    found = hits.select(*by, F.col("rank").cast("long"), "relevant", F.lit(0).cast("long").alias("n_rel"))
    wanted = cases.select(
        *by, F.lit(None).cast("long").alias("rank"), F.lit(False).alias("relevant"), F.col("n_rel").cast("long")
    )
    return found.unionByName(wanted)


def per_query(
    judged: DataFrame, k_values: Sequence[int] = DEFAULT_K, by: Sequence[str] = ("query_id",)
) -> DataFrame:
    """One row per query: precision_k, recall_k, ndcg_k for each k, hit_rate, rr."""
    ks = check_k(k_values)
    hit = F.col("relevant") & F.col("rank").isNotNull()
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    sums = [F.sum("n_rel").alias("n_rel"), F.count("rank").alias("n_ret"), F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        inside = hit & (F.col("rank") <= k)
        sums.append(F.coalesce(F.sum(F.when(inside, F.lit(1))), F.lit(0)).alias(f"hits_{k}"))
        sums.append(F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias(f"dcg_{k}"))
    totals = judged.groupBy(*by).agg(*sums)
    # Best possible gain when 1, 2, ... relevant chunks lead the list.
    ideal, running = [], 0.0
    for place in range(max(ks)):
        running += 1 / math.log2(place + 2)
        ideal.append(F.lit(running))
    best = F.array(*ideal)

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    columns: list[Column] = []
    for k in ks:
        shown = F.least(F.lit(k).cast("long"), F.col("n_ret"))
        columns.append(share(F.col(f"hits_{k}"), shown).alias(f"precision_{k}"))
    for k in ks:
        columns.append(share(F.col(f"hits_{k}"), F.col("n_rel")).alias(f"recall_{k}"))
    for k in ks:
        wanted = F.least(F.lit(k).cast("long"), F.col("n_rel")).cast("int")
        gain_here = F.when(wanted > 0, F.col(f"dcg_{k}") / F.get(best, wanted - 1))
        columns.append(F.coalesce(gain_here, F.lit(0.0)).alias(f"ndcg_{k}"))
    columns.append(F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("hit_rate"))
    columns.append(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))
    return totals.select(*by, *columns)


def metric_names(k_values: Sequence[int]) -> list[tuple[str, str, int]]:
    """(column, metric, k) in report order; k is 0 where the metric ignores it."""
    ks = check_k(k_values)
    names = [(f"{m}_{k}", m, k) for m in ("precision", "recall", "ndcg") for k in ks]
    return [*names, ("rr", "mrr", 0), ("hit_rate", "hit_rate", 0)]


def aggregate(
    queries: DataFrame, k_values: Sequence[int] = DEFAULT_K, by: Sequence[str] = ()
) -> DataFrame:
    """Means over queries as tall rows (by..., metric, k, value); no query gives zeros."""
    names = metric_names(k_values)
    means = queries.groupBy(*by).agg(*[F.avg(c).alias(c) for c, _, _ in names])
    rows = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(k).cast("long").alias("k"),
                F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias("value"),
            )
            for c, metric, k in names
        ]
    )
    return means.select(*by, F.explode(rows).alias("__row")).select(*by, "__row.*")


def winners(metrics: DataFrame, config: str = "config") -> DataFrame:
    """Mark the best value of every metric and k; all ties win, nulls never do."""
    best = metrics.groupBy("metric", "k").agg(F.max("value").alias("__best"))
    return metrics.join(best, ["metric", "k"]).select(
        config,
        "metric",
        "k",
        "value",
        F.coalesce(F.col("value") == F.col("__best"), F.lit(False)).alias("is_best"),
        F.when(F.col("value").isNull(), F.lit("—"))
        .when(F.col("value") == F.col("__best"), F.concat(F.lit("**"), fixed(F.col("value"), 4), F.lit("**")))
        .otherwise(fixed(F.col("value"), 4))
        .alias("cell"),
    )


def lift(metrics: DataFrame, stage: str = "stage", before: str = "base", after: str = "reranked") -> DataFrame:
    """Before, after and their difference side by side per metric and k."""
    keys = [c for c in metrics.columns if c not in (stage, "value")]
    pick = lambda s: F.max(F.when(F.col(stage) == s, F.col("value")))
    both = metrics.groupBy(*keys).agg(pick(before).alias("before"), pick(after).alias("after"))
    return both.withColumn("lift", F.col("after") - F.col("before"))


def regressions(run: DataFrame, baseline: DataFrame, allowed_drop: float) -> DataFrame:
    """Compare a run to a baseline; ``failed`` where a metric fell by more than allowed or is gone from the run.

    A metric that only the run has cannot fail.
    """
    old = baseline.select("metric", "k", F.col("value").alias("baseline"))
    new = run.select("metric", "k", "value")
    drop = F.col("baseline") - F.col("value")
    gone = F.col("value").isNull() & F.col("baseline").isNotNull()
    return new.join(old, ["metric", "k"], "full_outer").select(
        "metric", "k", "value", "baseline", drop.alias("drop"), (gone | F.coalesce(drop > allowed_drop, F.lit(False))).alias("failed")
    )
