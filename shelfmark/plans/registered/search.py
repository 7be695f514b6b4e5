"""Vector search over the ``embeddings`` table.

A vector is a chunk: five make a page, the label is its space. The queries are
the ``benchmark`` items, whose vectors have the same number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import cells as cl
from shelfmark.operators import lexical as lx
from shelfmark.operators import retrieval as rt
from shelfmark.operators.embedding import wrong_width
from shelfmark.operators.spread import stored
from shelfmark.operators.topk import Limits, topk
from shelfmark.plans.registered import query, table

K = 10
# A fixed query vector and fixed hyperplanes, written out in both languages.
PROBE = [round(math.cos(0.7 * i), 6) for i in range(64)]
PLANES = [[round(math.sin(1.3 * (p + 1) * (i + 1)), 6) for i in range(64)] for p in range(4)]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("chunk_id"),
        F.expr("vec_id div 5").alias("page_id"),
        (F.col("vec_id") % 5).alias("chunk_index"),
        F.concat(F.lit("S"), F.col("label")).alias("space_key"),
        F.array(F.concat(F.lit("L"), F.col("label"))).alias("labels"),
        F.col("embedding").alias("vector"),
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = corpus(spark, folder).select(
        F.col("chunk_id").alias("query_id"), "vector", "space_key", "page_id", "chunk_index"
    )
    return items.join(vectors, "query_id")


CORPUS_SQL = """corpus AS (
  SELECT vec_id AS chunk_id, vec_id // 5 AS page_id, vec_id % 5 AS chunk_index, 'S' || label AS space_key,
         ['L' || label] AS labels, embedding::DOUBLE[] AS vector
  FROM embeddings),
cases AS (
  SELECT b.item_id AS query_id, b.text AS query, c.vector, c.space_key, c.page_id, c.chunk_index
  FROM benchmark b JOIN corpus c ON c.chunk_id = b.item_id),
scored AS (
  SELECT q.query_id, q.space_key AS asked_space, q.page_id AS asked_page, c.chunk_id, c.space_key, c.page_id,
         round(list_cosine_similarity(q.vector, c.vector), 9) AS score
  FROM cases q CROSS JOIN corpus c)"""


def ranked_sql(source: str, name: str, k: int, where: str = "true", by: str = "query_id") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rank
  FROM {source} WHERE {where}
  QUALIFY rank <= {k})"""


@query(
    "cosine_pairs",
    f"""WITH {CORPUS_SQL}
SELECT a.chunk_id AS left_id, b.chunk_id AS right_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS score
FROM corpus a JOIN corpus b ON b.page_id = a.page_id AND b.chunk_index = a.chunk_index + 1""",
)
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each chunk and the next one of its page."""
    chunks = corpus(spark, folder)
    left = chunks.select(
        "page_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("chunk_id").alias("left_id"),
        F.col("vector").alias("a"),
    )
    right = chunks.select("page_id", "chunk_index", F.col("chunk_id").alias("right_id"), F.col("vector").alias("b"))
    joined = left.join(right, ["page_id", "chunk_index"])
    return joined.select("left_id", "right_id", F.round(rt.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    "topk_single",
    f"""WITH {CORPUS_SQL}
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT chunk_id, round(list_cosine_similarity({PROBE}::DOUBLE[], vector), 9) AS score FROM corpus)
WHERE score >= 0.05 ORDER BY score DESC, chunk_id LIMIT {K}""",
)
def topk_single(spark: SparkSession, folder: str) -> DataFrame:
    hits = rt.search(corpus(spark, folder), PROBE, k=K, threshold=0.05)
    return hits.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "topk_filtered",
    f"""WITH {CORPUS_SQL}
SELECT chunk_id, space_key, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT chunk_id, space_key, round(list_cosine_similarity({PROBE}::DOUBLE[], vector), 9) AS score
      FROM corpus WHERE space_key = 'S3' AND list_has_any(labels, ['L3', 'L4']))
WHERE score >= 0.0 ORDER BY score DESC, chunk_id LIMIT {K}""",
)
def topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    hits = rt.search(corpus(spark, folder), PROBE, k=K, threshold=0.0, space="S3", labels=["L3", "L4"])
    return hits.select(
        "chunk_id", F.lit("S3").alias("space_key"), F.round("score", 6).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "topk_batch",
    f"""WITH {CORPUS_SQL}, {ranked_sql('scored', 'hits', K, 'score >= 0.0')}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""",
)
def topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    """All benchmark queries in one pass over the chunks."""
    hits = rt.search_many(corpus(spark, folder), cases(spark, folder), k=K, threshold=0.0)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "topk_batch_blocks",
    f"""WITH {CORPUS_SQL}, {ranked_sql('scored', 'hits', K, 'chunk_id <> query_id')}
SELECT query_id, chunk_id, space_key, round(score, 6) AS score, rank FROM hits""",
)
def topk_batch_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The way taken when tasks cannot hold all queries: blocks of queries meet blocks of chunks."""
    few = Limits(query_rows=32)
    hits = topk(corpus(spark, folder), cases(spark, folder), K, skip_self=True, carry=("space_key",), limits=few)
    return hits.select(
        "query_id", "chunk_id", "space_key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "topk_role_scoped",
    f"""WITH {CORPUS_SQL}, grants AS (
  SELECT DISTINCT c_mktsegment AS role, 'S' || n_regionkey AS space_key
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000),
asked AS (
  SELECT item_id AS query_id, CASE WHEN length(text) > 200 THEN 'MACHINERY' ELSE 'BUILDING' END AS role FROM benchmark),
allowed AS (
  SELECT s.* FROM scored s JOIN asked a USING (query_id) JOIN grants g ON g.role = a.role AND g.space_key = s.space_key),
{ranked_sql('allowed', 'hits', 5)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""",
)
def topk_role_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Each query sees only the spaces its role was granted."""
    people = table(spark, folder, "customer").where(F.col("c_acctbal") > 9000)
    nations = table(spark, folder, "nation")
    grants = (
        people.join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(F.col("c_mktsegment").alias("role"), F.concat(F.lit("S"), F.col("n_regionkey")).alias("space_key"))
        .distinct()
    )
    asked = cases(spark, folder).select(
        "query_id", "vector", F.when(F.length("query") > 200, "MACHINERY").otherwise("BUILDING").alias("role")
    )
    hits = rt.search_by_role(corpus(spark, folder), asked, grants, k=5)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _side_sql(column: str) -> str:
    sides = [f"CASE WHEN list_inner_product({column}, {plane}::DOUBLE[]) >= 0 THEN '1' ELSE '0' END" for plane in PLANES]
    return " || ".join(sides)


@query(
    "topk_lsh_recall",
    f"""WITH {CORPUS_SQL}, sided AS (SELECT chunk_id, {_side_sql('vector')} AS side FROM corpus),
near AS (
  SELECT s.* FROM scored s JOIN sided c ON c.chunk_id = s.chunk_id JOIN sided q ON q.chunk_id = s.query_id
  WHERE hamming(c.side, q.side) <= 1),
{ranked_sql('scored', 'exact', K)}, {ranked_sql('near', 'found', K)}
SELECT e.query_id, count(*)::BIGINT AS n_exact, count(f.chunk_id)::BIGINT AS n_found,
       round(count(f.chunk_id) / count(*), 6) AS recall
FROM exact e LEFT JOIN found f USING (query_id, chunk_id) GROUP BY e.query_id""",
)
def topk_lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the exact result a search of the nearby buckets finds."""
    chunks, asked = corpus(spark, folder), cases(spark, folder).select("query_id", "vector")
    exact = topk(chunks, asked, K)
    found = rt.search_approximate(chunks, asked, PLANES, k=K)
    recall = rt.recall_against(exact, found)
    return recall.select("query_id", "n_exact", "n_found", F.round("recall", 6).alias("recall"))


@query(
    "topk_cells_recall",
    f"""WITH {CORPUS_SQL}, asked AS (
  SELECT q.chunk_id AS query_id, c.chunk_id, round(list_cosine_similarity(q.vector, c.vector), 9) AS score
  FROM corpus q CROSS JOIN corpus c WHERE q.chunk_id % 50 = 0),
{ranked_sql('asked', 'exact', K)}
SELECT query_id, count(*)::BIGINT AS n_exact, true AS reached FROM exact GROUP BY query_id""",
)
def topk_cells_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth chunk searched in an index of cells; ``reached``: over all of them it finds nine tenths of the exact hits."""
    chunks = corpus(spark, folder).select("chunk_id", "vector")
    asked = chunks.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    fitted = cl.fit_cells(chunks, k=K)
    found = cl.search_cells(cl.build_index(chunks, fitted), fitted, asked, K)
    recall = stored(rt.recall_against(topk(chunks, asked, K), found))
    mean = recall.agg(F.avg("recall")).first()[0]
    return recall.select("query_id", "n_exact", F.lit(mean is not None and mean >= 0.9).alias("reached"))


def word_terms(column: str) -> F.Column:
    return F.array_distinct(tx.words(F.lower(F.col(column))))


HYBRID_SQL = f"""WITH {CORPUS_SQL}, {ranked_sql('scored', 'dense', 20)},
chunk_terms AS (
  SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS term
  FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
query_terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '\\S+')) AS term FROM cases),
totals AS (SELECT query_id, count(*) AS n FROM query_terms GROUP BY query_id),
covered AS (
  SELECT q.query_id, c.chunk_id, round(count(*) / any_value(t.n), 9) AS score
  FROM query_terms q JOIN chunk_terms c USING (term) JOIN totals t USING (query_id) GROUP BY q.query_id, c.chunk_id),
{ranked_sql('covered', 'lexical', 20)},
both_lists AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM lexical),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM both_lists GROUP BY query_id, chunk_id),
{ranked_sql('fused', 'hits', K)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits"""


def _hybrid(spark: SparkSession, folder: str, limits: Limits) -> DataFrame:
    chunks, asked = corpus(spark, folder), cases(spark, folder)
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    texts = texts.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    texts = texts.select("chunk_id", word_terms("text").alias("terms"))
    dense = topk(chunks, asked.select("query_id", "vector"), 20)
    lexical = lx.lexical_hits(texts, asked.select("query_id", word_terms("query").alias("terms")), 20, limits)
    hits = rt.fuse(dense, lexical, K)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("hybrid_rrf", HYBRID_SQL)
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Vector and word ranks fused; the text of a chunk is the document of the same number."""
    return _hybrid(spark, folder, Limits())


@query("hybrid_rrf_index", HYBRID_SQL)
def hybrid_rrf_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same with an inverted index on the word side, the way for query sets beyond what a task may hold."""
    return _hybrid(spark, folder, Limits(query_rows=8))


@query(
    "dim_violations",
    f"""WITH {CORPUS_SQL}
SELECT chunk_id, len(vector)::BIGINT AS width, CASE WHEN space_key IN ('S2', 'S7') THEN 32 ELSE 64 END::BIGINT AS expected
FROM corpus WHERE space_key IN ('S2', 'S7')""",
)
def dim_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that do not have the width their space's profile states."""
    expected = F.when(F.col("space_key").isin("S2", "S7"), 32).otherwise(64)
    stated = corpus(spark, folder).withColumn("expected", expected.cast("long"))
    return wrong_width(stated, "vector", "expected").select("chunk_id", F.size("vector").cast("long").alias("width"), "expected")


@query(
    "vector_literal",
    """SELECT vec_id, len(embedding)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total,
       true AS same FROM embeddings""",
)
def vector_literal(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as text and read back are the same."""
    written = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", tx.vector_to_literal(F.col("embedding")).alias("literal")
    )
    back = written.withColumn("read", tx.vector_from_literal(F.col("literal")))
    total = F.aggregate("read", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select(
        "vec_id", F.size("read").cast("long").alias("width"), F.round(total, 6).alias("total"),
        (F.col("read") == F.col("embedding")).alias("same"),
    )


@query(
    "count_by_space",
    f"WITH {CORPUS_SQL} SELECT space_key, count(*)::BIGINT AS n FROM corpus WHERE space_key <> '' GROUP BY space_key",
)
def count_by_space(spark: SparkSession, folder: str) -> DataFrame:
    named = corpus(spark, folder).where(F.col("space_key") != "")
    return named.groupBy("space_key").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_pages", f"WITH {CORPUS_SQL} SELECT DISTINCT space_key, page_id FROM corpus")
def distinct_pages(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("space_key", "page_id").distinct()


@query("peek_chunks", f"WITH {CORPUS_SQL} SELECT chunk_id, page_id, space_key FROM corpus ORDER BY chunk_id LIMIT 25")
def peek_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A first look at the table: the 25 lowest ids."""
    return corpus(spark, folder).select("chunk_id", "page_id", "space_key").orderBy("chunk_id").limit(25)
