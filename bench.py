"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_REPEAT.
Every query runs to the end over its whole tables; the best of the repeats counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.topk import topk
from shelfmark.plans import registered
from shelfmark.plans.registered import search
from shelfmark.session import local_session

HEADLINE = (
    "topk_batch", "topk_batch_blocks", "eval_aggregate", "eval_per_query", "hybrid_rrf", "pooled_hits", "context_blocks",
    "chunk_fixed", "chunk_html_section", "html_to_text", "embed_documents", "history_budget", "rate_limit",
    "events_dedupe", "replace_pages", "tickets_normalize", "golden_build", "cache_lookup", "ab_compare",
)


def topk_batch_x50(spark: SparkSession, folder: str) -> DataFrame:
    """The batch search with every chunk vector repeated fifty times."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(49))).alias("copy")
    chunks = search.corpus(spark, folder).select("chunk_id", "vector", copies)
    many = chunks.select((F.col("chunk_id") * 50 + F.col("copy")).alias("chunk_id"), "vector")
    return topk(many, search.cases(spark, folder).select("query_id", "vector"), 10)


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    registered.load_all()
    queries = {name: registered.QUERIES[name] for name in HEADLINE}
    queries["topk_batch_x50"] = topk_batch_x50
    spark = local_session(cores, "bench")
    run(queries["topk_batch"](spark, folder))  # starts the Python workers
    times: dict[str, float] = {}
    for name, build in queries.items():
        spent = []
        for _ in range(repeat):
            start = time.perf_counter()
            run(build(spark, folder))
            spent.append(time.perf_counter() - start)
        times[name] = round(min(spent), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
