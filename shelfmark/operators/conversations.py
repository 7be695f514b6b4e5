"""Chat histories: latest message, recent turns, token budget.

Rows are (conv_id, turn, role, text); ``turn`` is a whole number unique within
the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import estimate_tokens
from shelfmark.operators.ordered import running_sum

HISTORY_TURNS = 8
HISTORY_TOKENS = 4000


def latest_user_message(turns: DataFrame) -> DataFrame:
    users = turns.where(F.col("role") == "user")
    return users.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("message"))


def has_prior_turns(turns: DataFrame) -> DataFrame:
    spoken = F.count_if(F.col("role") != "system")
    return turns.groupBy("conv_id").agg(spoken.alias("n_spoken"), (spoken > 1).alias("has_prior"))


def history_text(turns: DataFrame, most: int = HISTORY_TURNS) -> DataFrame:
    """The last turns as ``role: text`` lines.

    Filtering a row number lets Spark cut each task to ``most`` rows per
    conversation before the shuffle, so long conversations stay cheap.
    """
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = (
        turns.where(F.col("role") != "system")
        .withColumn("__place", F.row_number().over(recent))
        .where(F.col("__place") <= most)
    )
    line = F.concat("role", F.lit(": "), "text")
    lines = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select(
        "conv_id", F.size("l").cast("long").alias("n_turns"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history")
    )


def history_for_model(turns: DataFrame) -> DataFrame:
    """Spoken turns, plus the latest user message once more unless it comes last."""
    spoken = turns.where(F.col("role") != "system")
    last = spoken.groupBy("conv_id").agg(
        F.max("turn").alias("__last"),
        F.max_by("role", "turn").alias("__role"),
        F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("text"),
        F.count_if(F.col("role") == "user").alias("__asked"),
    )
    repeated = last.where((F.col("__role") != "user") & (F.col("__asked") > 0)).select(
        "conv_id", (F.col("__last") + 1).alias("turn"), F.lit("user").alias("role"), "text"
    )
    return spoken.select("conv_id", "turn", "role", "text").unionByName(repeated)


def history_budget(turns: DataFrame, budget: int = HISTORY_TOKENS) -> DataFrame:
    """Newest turns that fit the budget; the newest one is always kept."""
    counted = running_sum(turns, ["conv_id"], "turn", estimate_tokens(F.col("text")), "tokens_so_far", descending=True)
    return counted.where((F.col("tokens_so_far") <= budget) | F.col("tokens_so_far_first")).drop("tokens_so_far_first")
