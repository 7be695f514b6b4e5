"""Word search: the best k chunks per query by the share of its distinct terms that they hold.

Query sets that a task can hold are answered by one pass over the chunks. Beyond
that bound an inverted index is asked, in the manner of MaxScore: the first ``k``
postings of every asked term give each query a k-th best result to beat, and
from then on only terms that a better chunk cannot do without are looked up.
Common words are the first to drop out, so they are not joined in full.

Every hit of a term weighs the same, so postings in order of their weight are
postings in order of the chunk id, which also breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.spread import stored
from shelfmark.operators.topk import SCORE_DECIMALS, Limits, held_queries, rank_hits, score_topk


def lexical_hits(chunks: DataFrame, queries: DataFrame, k: int, limits: Limits = Limits()) -> DataFrame:
    """Ranked hits (query_id, chunk_id, score, rank); both sides hold distinct ``terms``.

    Chunks without a term of the query are no hits, and queries without terms have none.
    """
    asked = queries.where(F.size("terms") > 0).select("query_id", "terms")
    held = held_queries(asked, limits)
    if held is not None:
        return rank_hits(score_topk(chunks, asked, k, field="terms", held=held), k)
    return indexed_hits(chunks, asked, k)


def postings(chunks: DataFrame) -> DataFrame:
    """The index: (term, chunk_id), one row per distinct term of a chunk. Stored by ``term`` it serves many searches."""
    return chunks.select("chunk_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())


def indexed_hits(chunks: DataFrame, asked: DataFrame, k: int, index: DataFrame | None = None) -> DataFrame:
    """The same hits by way of the index, for any number of queries."""
    asked = stored(asked)
    index = stored(postings(chunks).join(asked.select(F.explode("terms").alias("term")), "term", "left_semi")) if index is None else index
    terms = stored(asked_terms(index, asked))
    first = stored(counted(chunks, asked, seeds(index, terms, k)))
    ranked = first.withColumn("place", F.row_number().over(_best()))
    # The k-th best so far; a query with fewer has no term with k postings, so it has seen them all.
    kth = ranked.where(F.col("place") == k).select("query_id", F.col("hits").alias("least"), F.col("chunk_id").alias("last_id"))
    more = candidates(index, terms, kth).join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    best = ranked.where(F.col("place") <= k).drop("place").unionByName(counted(chunks, asked, more))
    share = F.round(F.col("hits") / F.col("size"), SCORE_DECIMALS)
    return rank_hits(best.select("query_id", "chunk_id", share.alias("score")), k)


def _best() -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("hits"), F.asc("chunk_id"))


def asked_terms(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, term, rarity, known): a query's terms that the index has, the rarest as number 1, and how many they are."""
    wanted = asked.select("query_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    sizes = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    found = wanted.join(sizes, "term")
    by_query = Window.partitionBy("query_id")
    return found.select(
        "query_id", "term", F.row_number().over(by_query.orderBy("n", "term")).alias("rarity"), F.count(F.lit(1)).over(by_query).alias("known"),
    )


def seeds(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Pairs (query_id, chunk_id) of each asked term's first ``k`` postings; every task keeps k of a term before the shuffle."""
    order = Window.partitionBy("term").orderBy("chunk_id")
    first = index.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    return first.join(terms.select("query_id", "term"), "term").select("query_id", "chunk_id").distinct()


def candidates(index: DataFrame, terms: DataFrame, kth: DataFrame) -> DataFrame:
    """Pairs (query_id, chunk_id) that could still be among the best.

    A chunk with more than ``least`` of a query's ``known`` terms holds one of
    its ``known - least`` rarest. One with exactly ``least`` may hold only the
    next rarest, and then counts only before ``last_id``.
    """
    reach = F.col("known") - F.col("least")
    needed = terms.join(kth, "query_id").where(F.col("rarity") <= reach + 1)
    bound = F.when(F.col("rarity") > reach, F.col("last_id"))
    needed = needed.select("query_id", "term", bound.alias("before"))
    met = index.join(needed, "term").where(F.col("before").isNull() | (F.col("chunk_id") < F.col("before")))
    return met.select("query_id", "chunk_id").distinct()


def counted(chunks: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, hits, size) of the pairs: terms in common, and distinct terms of the query."""
    wanted = asked.select("query_id", F.col("terms").alias("asked"))
    both = pairs.join(wanted, "query_id").join(chunks.select("chunk_id", "terms"), "chunk_id")
    return both.select("query_id", "chunk_id", F.size(F.array_intersect("asked", "terms")).alias("hits"), F.size("asked").alias("size"))
