"""The corpus pipeline: from raw documents to tokens of good, deduplicated, uncontaminated texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontaminate, line_chunks, near_dedup, quality
from shelfmark.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    models = quality.fit_models(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    return quality.score(docs, models).where("accepted").select(*[F.col(f"`{c}`") for c in names])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that came before."""
    return line_chunks.deduped_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the text decoded from them."""
    return bpe.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark), ("bpe", tokens),
]

#: The classifier, the near-duplicates and the tokens are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
