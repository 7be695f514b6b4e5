"""Search and what follows it: pooling, fallback, reranking, context, fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as tx
from shelfmark.operators.spread import explode_once
from shelfmark.operators.topk import Limits, rank_hits, score_topk, topk

DEFAULT_TOP_K = 5
DEFAULT_THRESHOLD = 0.7
MAX_TOP_K = 50
# The semantic ticket cache.
CACHE_TOP_K = 3
CACHE_MIN_SCORE = 0.8
CACHE_STRONG_SCORE = 0.92
RRF_CONSTANT = 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def filter_chunks(
    chunks: DataFrame, *, space: str | None = None, labels: Sequence[str] | None = None
) -> DataFrame:
    """Space and label filters; an empty filter means no filter. They reach the scan."""
    if space:
        chunks = chunks.where(F.col("space_key") == space)
    if labels:
        clean = F.array_compact(F.coalesce("labels", F.array().cast("array<string>")))
        chunks = chunks.where(F.arrays_overlap(clean, F.array(*[F.lit(x) for x in labels])))
    return chunks


def search(
    chunks: DataFrame,
    vector: Sequence[float],
    *,
    k: int = DEFAULT_TOP_K,
    threshold: float | None = DEFAULT_THRESHOLD,
    space: str | None = None,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Best k chunks for one query vector, with rank and score."""
    spark = chunks.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vector array<double>")
    scored = score_topk(filter_chunks(chunks, space=space, labels=labels), query, k, threshold=threshold)
    return rank_hits(scored, k).drop("query_id")


def check_limit(k: int) -> int:
    """The bound the search tool puts on a caller's limit."""
    if not 0 < k <= MAX_TOP_K:
        raise ValueError(f"limit must be between 1 and {MAX_TOP_K}, got {k}")
    return k


def search_many(
    chunks: DataFrame, queries: DataFrame, *, k: int = DEFAULT_TOP_K,
    threshold: float | None = DEFAULT_THRESHOLD, skip_self: bool = False, limits: Limits = Limits(),
) -> DataFrame:
    """Ranked hits of many queries in one pass over the chunks."""
    return topk(chunks, queries, k, threshold=threshold, skip_self=skip_self, limits=limits)


def search_by_role(
    chunks: DataFrame, queries: DataFrame, grants: DataFrame, *, k: int,
    threshold: float | None = None, limits: Limits = Limits(),
) -> DataFrame:
    """Each query sees only the spaces its role was granted (role, space_key).

    The grants are gathered per role - a list of space names, not of rows - and
    become the scopes of the role's queries.
    """
    allowed = grants.groupBy("role").agg(F.collect_set("space_key").alias("scopes"))
    scoped = queries.join(allowed, "role", "left").withColumn(
        "scopes", F.coalesce("scopes", F.array().cast("array<string>"))
    )
    corpus = chunks.withColumn("scope", F.col("space_key"))
    return topk(corpus, scoped, k, threshold=threshold, limits=limits)


def cache_lookup(
    cache: DataFrame, questions: DataFrame, *, k: int = CACHE_TOP_K, least: float = CACHE_MIN_SCORE,
    strong: float = CACHE_STRONG_SCORE, limits: Limits = Limits(),
) -> DataFrame:
    """Similar resolved tickets of the same project, with a flag for strong matches.

    ``cache`` has ticket_key, project_key, vector; ``questions`` has query_id,
    project_key, vector.
    """
    corpus = cache.select(F.col("ticket_key").alias("chunk_id"), "vector", F.col("project_key").alias("scope"))
    asked = questions.select("query_id", "vector", F.array("project_key").alias("scopes"))
    hits = topk(corpus, asked, k, threshold=least, limits=limits)
    return hits.withColumnRenamed("chunk_id", "ticket_key").withColumn("strong", F.col("score") >= strong)


def expand(questions: DataFrame, question_id: str = "question_id", message: str = "message") -> DataFrame:
    """Sub-queries (question_id, sub_idx, sub_query); the message itself is number 0."""
    return explode_once(questions, [question_id], tx.split_questions(F.col(message)), "sub_idx", "sub_query")


def pool(hits: DataFrame, question_id: str = "question_id") -> DataFrame:
    """One row per chunk of a question: the hit of the first sub-query wins."""
    rest = [c for c in hits.columns if c not in (question_id, "chunk_id")]
    first = F.min_by(F.struct(*rest), F.struct("sub_idx", "rank"))
    pooled = hits.groupBy(question_id, "chunk_id").agg(first.alias("__hit"))
    return pooled.select(question_id, "chunk_id", "__hit.*")


def with_fallback(questions: DataFrame, hits: DataFrame, raw_hits: DataFrame, question_id: str) -> DataFrame:
    """Questions whose sub-queries found nothing take the raw message's hits."""
    empty = questions.select(question_id).join(hits, question_id, "left_anti")
    return hits.unionByName(raw_hits.join(empty, question_id, "left_semi"))


def lexical_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct lower-case words that the document contains; 0.0 with nothing to compare."""
    asked = F.array_distinct(tx.words(F.lower(query)))
    found = F.array_intersect(asked, tx.words(F.lower(document)))
    share = F.try_divide(F.size(found).cast("double"), F.size(asked).cast("double"))
    return F.coalesce(share, F.lit(0.0))


def rerank(
    candidates: DataFrame, score: Column, *, by: Sequence[str] = ("query_id",), top_n: int = 10,
    threshold: float = 0.0,
) -> DataFrame:
    """Order candidates by a second score: first the best N, then the threshold."""
    order = Window.partitionBy(*by).orderBy(F.desc("rerank_score"), F.asc("chunk_id"))
    return (
        candidates.withColumn("rerank_score", F.round(score, 9))
        .where(F.col("rerank_score").isNotNull())
        .withColumn("rerank_rank", F.row_number().over(order))
        .where((F.col("rerank_rank") <= top_n) & (F.col("rerank_score") >= threshold))
    )


def keep_known(reranked: DataFrame, candidates: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Drop results a reranker returned for chunks outside the candidate pool."""
    return reranked.join(candidates.select(*by, "chunk_id"), [*by, "chunk_id"], "left_semi")


def rerank_or_base(scored: DataFrame, *, by: Sequence[str] = ("query_id",), top_n: int = 10,
                   threshold: float = 0.0) -> DataFrame:
    """Final order where a scorer may fail for some candidates (``error`` not null).

    If any candidate of a query failed, the query keeps its first-stage order;
    if the scorer kept nothing, the query ends up without context. ``scored``
    has rank, rerank_score and error; a query's candidates are few.
    """
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.desc_nulls_last("rerank_score"), F.asc("chunk_id"))
    failed = F.max(F.col("error").isNotNull()).over(whole)
    marked = scored.withColumn("used_base", failed).withColumn("__place", F.row_number().over(order))
    kept = F.col("used_base") | (
        (F.col("__place") <= top_n) & (F.col("rerank_score") >= threshold)
    )
    return (
        marked.where(kept)
        .withColumn("final_rank", F.when(F.col("used_base"), F.col("rank")).otherwise(F.col("__place")))
        .drop("__place")
    )


def context_blocks(hits: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Per sub-query one block: the query line, then its hits in rank order.

    A sub-query has at most k hits, so the list built here is short.
    """
    block = tx.hit_block(F.col("title"), F.col("score"), F.col("url"), F.col("content"), F.col("rank"))
    gathered = hits.groupBy(question_id, "sub_idx", "sub_query").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))).alias("blocks")
    )
    texts = F.array_join(F.transform("blocks", lambda b: b["text"]), tx.BLOCK_SEPARATOR)
    return gathered.select(
        question_id, "sub_idx",
        F.concat(F.lit("Query: "), F.col("sub_query"), F.lit("\n"), tx.strip(texts)).alias("block"),
    )


def merge_context(blocks: DataFrame, question_id: str = "question_id") -> DataFrame:
    """All blocks of a question (at most one per sub-query) in sub-query order."""
    gathered = blocks.groupBy(question_id).agg(F.array_sort(F.collect_list(F.struct("sub_idx", "block"))).alias("b"))
    return gathered.select(
        question_id, F.array_join(F.transform("b", lambda b: b["block"]), tx.BLOCK_SEPARATOR).alias("context")
    )


def refuse(questions: DataFrame, contexts: DataFrame, *, answers: dict[str, str], question_id: str = "question_id",
           message: str = "message") -> DataFrame:
    """Questions without context get the fixed refusal in their language."""
    language = tx.language_of(F.col(message))
    refusal = F.when(language == "de", F.lit(answers["de"])).otherwise(F.lit(answers["en"]))
    joined = questions.join(contexts.select(question_id, "context"), question_id, "left")
    return joined.select(
        question_id,
        language.alias("language"),
        F.col("context").isNull().alias("refused"),
        F.when(F.col("context").isNull(), refusal).alias("answer"),
    )


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists, best k per query."""
    both = first.select("query_id", "chunk_id", "rank").unionByName(second.select("query_id", "chunk_id", "rank"))
    part = F.lit(1.0) / (F.lit(constant) + F.col("rank"))
    fused = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    return rank_hits(fused, k)


def with_signature(
    df: DataFrame, planes: Sequence[Sequence[float]], name: str = "scope"
) -> DataFrame:
    """Adds which side of each hyperplane the vector lies on, as a string of 0 and 1."""
    normals = np.asarray(planes, dtype=np.float64)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector"))
            rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, normals.shape[1])
            sides = np.where(rows.astype(np.float64) @ normals.T >= 0, "1", "0")
            signs = pa.array(["".join(side) for side in sides], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, signs], names=[*batch.schema.names, name]
            )

    return df.where(F.col("vector").isNotNull()).mapInArrow(run, schema)


def probe_buckets(signature: Column, bits: int) -> Column:
    """The signature itself and every one that differs in a single bit."""

    def flipped(bit: int) -> Column:
        other = F.when(F.substring(signature, bit + 1, 1) == "1", "0").otherwise("1")
        return F.concat(F.left(signature, F.lit(bit)), other, F.substring(signature, bit + 2, bits))

    return F.array(signature, *[flipped(bit) for bit in range(bits)])


def search_approximate(
    chunks: DataFrame, queries: DataFrame, planes: Sequence[Sequence[float]], *, k: int,
    threshold: float | None = None, skip_self: bool = False, limits: Limits = Limits(),
) -> DataFrame:
    """Search only nearby hyperplane buckets; scores of what is found are exact.

    A chunk table stored by ``scope`` lets the scan skip the other buckets. No
    pairs are formed inside a bucket, so a crowded bucket costs no more than
    its own rows.
    """
    corpus = chunks if "scope" in chunks.columns else with_signature(chunks, planes)
    signed = with_signature(queries, planes, "signature")
    probing = signed.withColumn("scopes", probe_buckets(F.col("signature"), len(planes)))
    return topk(corpus, probing, k, threshold=threshold, skip_self=skip_self, limits=limits)


def recall_against(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact hits that another search also found, per query."""
    seen = found.select("query_id", "chunk_id", F.lit(1).alias("__seen"))
    joined = exact.select("query_id", "chunk_id").join(seen, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("__seen").alias("n_found"),
        (F.count("__seen") / F.count(F.lit(1))).alias("recall"),
    )
