"""From chat histories to model-ready prompts: expand, search, pool, budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import conversations as conv
from shelfmark.operators import retrieval as rt
from shelfmark.operators.embedding import hashed_words
from shelfmark.operators.topk import Limits

CONTEXT_TOKENS = 3200
SYSTEM_TEXT = "Answer only from the context below. If it does not hold the answer, say so."
REFUSALS = {
    "en": "I could not find an answer to this in the knowledge base.",
    "de": "Dazu konnte ich in der Wissensbasis keine Antwort finden.",
}


def questions_of(turns: DataFrame) -> DataFrame:
    latest = conv.latest_user_message(turns)
    return latest.select(F.col("conv_id").alias("question_id"), "message")


def sub_query_hits(
    questions: DataFrame, corpus: DataFrame, *, k: int, threshold: float | None, width: int = 0, limits: Limits = Limits(),
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked hits of every sub-query (question_id, sub_idx, sub_query, chunk_id, score, rank).

    ``corpus`` has chunk_id and vector. Sub-queries are numbered so that one
    search serves all of them. ``embed`` gets (query_id, sub_query) and returns
    (query_id, vector), as the model that made the corpus does for queries; the
    default is the word hash of ``width``.
    """
    parts = rt.expand(questions).withColumn(
        "query_id", F.concat_ws("/", F.col("question_id").cast("string"), F.col("sub_idx").cast("string"))
    )
    asked = parts.select("query_id", "sub_query")
    vectors = embed(asked) if embed else hashed_words(asked, "sub_query", width=width, keep_text=False)
    hits = rt.search_many(corpus, vectors, k=k, threshold=threshold, limits=limits)
    place = F.split("query_id", "/", 2)
    question_type = questions.schema["question_id"].dataType
    numbered = hits.select(
        F.get(place, F.lit(0)).cast(question_type).alias("question_id"),
        F.get(place, F.lit(1)).cast("int").alias("sub_idx"),
        "chunk_id", "score", "rank",
    )
    return numbered.join(parts.select("question_id", "sub_idx", "sub_query"), ["question_id", "sub_idx"])


def prompts(turns: DataFrame, contexts: DataFrame, *, context_tokens: int = CONTEXT_TOKENS,
            history_tokens: int = conv.HISTORY_TOKENS) -> DataFrame:
    """One row per message to send: system text with context, then the kept history."""
    history = conv.history_budget(conv.history_for_model(turns), history_tokens)
    blocks = F.split("context", F.lit(rf"\Q{tx.BLOCK_SEPARATOR}\E"), -1)
    answered = contexts.select(F.col("question_id").alias("conv_id"), tx.trim_to_budget(blocks, context_tokens).alias("context"))
    system = answered.select(
        "conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"),
        F.concat(F.lit(f"{SYSTEM_TEXT}\n\nContext:\n"), F.col("context")).alias("text"),
    )
    kept = history.join(answered.select("conv_id"), "conv_id", "left_semi")
    return system.unionByName(kept.select("conv_id", "turn", "role", "text"))
