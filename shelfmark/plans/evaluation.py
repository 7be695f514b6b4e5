"""Search, rerank and score a golden set, for one or many configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import metrics
from shelfmark.operators.topk import Limits, topk

SEARCH_LIMIT = 20


def evaluate_pairs(
    chunks: DataFrame, cases: DataFrame, relevant: DataFrame, *, k_values: Sequence[int] = metrics.DEFAULT_K,
    search_limit: int = SEARCH_LIMIT, threshold: float | None = 0.0, limits: Limits = Limits(),
) -> DataFrame:
    """Per-query metrics for cases with listed relevant chunks."""
    hits = topk(chunks, cases, search_limit, threshold=threshold, limits=limits)
    return metrics.per_query(metrics.judge_pairs(hits, relevant), k_values)


def with_rerank_stage(hits: DataFrame, score: Column, *, top_n: int = 10, threshold: float = 0.0,
                      by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Hits of both stages as rows with ``stage`` base or reranked.

    Both ranks are put on the same row and then unfolded, so the search itself
    runs once.
    """
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("rerank_score"), F.asc("chunk_id"))
    marked = hits.withColumn("rerank_score", F.round(score, 9)).withColumn("__place", F.row_number().over(order))
    kept = (F.col("__place") <= top_n) & (F.col("rerank_score") >= threshold)
    stages = F.array(
        F.struct(F.lit("base").alias("stage"), F.col("rank").cast("long").alias("rank")),
        F.struct(F.lit("reranked").alias("stage"), F.when(kept, F.col("__place").cast("long")).alias("rank")),
    )
    rest = [c for c in hits.columns if c != "rank"]
    unfolded = marked.select(*rest, F.explode(stages).alias("__s"))
    return unfolded.select(*rest, "__s.stage", "__s.rank").where(F.col("rank").isNotNull())


def with_thresholds(hits: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The hits that each threshold would have let through; ranks do not change.

    Raising a threshold only cuts a ranked list at its end, so one search at
    the lowest threshold serves the whole sweep.
    """
    steps = F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])).alias("threshold")
    return hits.select("*", steps).where(F.col("score") >= F.col("threshold"))


def refusal_accuracy(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of questions refused exactly when they cannot be answered."""
    joined = cases.join(answers.select("question_id", "refused"), "question_id")
    right = F.col("answerable") != F.col("refused")
    return joined.groupBy("answerable").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy")
    )


def report_lines(aggregated: DataFrame, title: str) -> list[str]:
    """Markdown table of one run's means; a few dozen rows by construction."""
    rows = {(r["metric"], r["k"]): r["value"] for r in aggregated.collect()}
    ks = sorted({k for metric, k in rows if k})
    lines = [f"# {title}", "", "| k | Precision@k | Recall@k | nDCG@k |", "|---|---|---|---|"]
    for k in ks:
        cells = " | ".join(f"{rows[(m, k)]:.4f}" for m in ("precision", "recall", "ndcg"))
        lines.append(f"| {k} | {cells} |")
    return [*lines, "", f"- Hit rate: {rows[('hit_rate', 0)]:.4f}", f"- MRR: {rows[('mrr', 0)]:.4f}"]


def write_report(aggregated: DataFrame, per_query: DataFrame, path: str, title: str) -> None:
    """Means as JSON and Markdown, per-query rows as JSON lines next to them."""
    per_query.write.mode("overwrite").json(f"{path}/per_query")
    aggregated.coalesce(1).write.mode("overwrite").json(f"{path}/aggregated")
    spark = aggregated.sparkSession
    text = spark.createDataFrame([("\n".join(report_lines(aggregated, title)),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/summary")
