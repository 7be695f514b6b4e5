"""Questions from ``conversations`` searched over ``documents``.

A document is a chunk; vectors are the offline word-hash default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import retrieval as rt
from shelfmark.operators.embedding import hashed_words
from shelfmark.plans import answering as an
from shelfmark.plans import evaluation as ev
from shelfmark.plans.registered import query, table
from shelfmark.plans.registered.search import ranked_sql

WIDTH = 64
K = 3
THRESHOLD = 0.7
CONTEXT_TOKENS = 900
SEP_SQL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("lang") != "es", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("doc://"), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("url"),
        F.col("text").alias("content"),
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return hashed_words(texts, "text", width=WIDTH, keep_text=False)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return an.questions_of(table(spark, folder, "conversations"))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    return an.sub_query_hits(questions(spark, folder), corpus(spark, folder), k=K, threshold=THRESHOLD, width=WIDTH)


def vector_sql(source: str, key: str, text: str, name: str) -> str:
    """Word counts per hash bucket and their norms, in SQL."""
    return f"""{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '\\S+')) AS w FROM {source}),
{name} AS (
  SELECT {key}, ('0x' || left(md5(w), 4))::INT % {WIDTH} AS b, count(*)::DOUBLE AS n FROM {name}_words GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY {key})"""


TRIM = "'" + chr(9) + "' || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
QUESTIONS_SQL = f"""questions AS (
  SELECT conv_id AS question_id, max_by(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id),
parts AS (
  SELECT question_id, message, list_filter(
    list_transform(regexp_split_to_array(trim(message, {TRIM}), '(?i)\\?+|\\b(?:und|and)\\b'), lambda p: trim(p, {TRIM})),
    lambda p: length(p) >= 5) AS found
  FROM questions),
numbered AS (
  SELECT question_id, trim(message, {TRIM}) AS sub_query, 0 AS place FROM parts
  UNION ALL SELECT question_id, found[i], i FROM parts, range(1, len(found) + 1) AS r(i)),
firsts AS (SELECT question_id, sub_query, min(place) AS place FROM numbered GROUP BY ALL),
sub_queries AS (
  SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY place) - 1)::INT AS sub_idx, sub_query FROM firsts
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY place) <= 5)"""

HITS_SQL = f"""{QUESTIONS_SQL},
{vector_sql('documents', 'doc_id', 'text', 'dv')},
{vector_sql('sub_queries', 'question_id, sub_idx', 'sub_query', 'qv')},
dots AS (
  SELECT question_id, sub_idx, doc_id, sum(q.n * d.n) AS dot FROM qv q JOIN dv d USING (b) GROUP BY ALL),
scored AS (
  SELECT question_id, sub_idx, doc_id AS chunk_id, round(dot / (qn.norm * dn.norm), 9) AS score
  FROM dots JOIN qv_norm qn USING (question_id, sub_idx) JOIN dv_norm dn USING (doc_id)),
{ranked_sql('scored', 'ranked', K, f'score >= {THRESHOLD}', 'question_id, sub_idx')},
hits AS (SELECT r.*, s.sub_query FROM ranked r JOIN sub_queries s USING (question_id, sub_idx)),
docs AS (
  SELECT doc_id AS chunk_id, CASE WHEN lang <> 'es' THEN source || '/' || doc_id END AS title,
         CASE WHEN lang <> 'fr' THEN 'doc://' || lang || '/' || doc_id END AS url, text AS content, lang FROM documents)"""

BLOCK_SQL = """'### ' || coalesce(title, 'Result ' || rank) || ' (score=' || printf('%.3f', score) || ')' ||
  CASE WHEN url <> '' THEN chr(10) || 'Source: ' || url ELSE '' END || chr(10) || content"""


@query(
    "query_expand",
    f"WITH {QUESTIONS_SQL} SELECT question_id, sub_idx::BIGINT AS sub_idx, sub_query FROM sub_queries",
)
def query_expand(spark: SparkSession, folder: str) -> DataFrame:
    parts = rt.expand(questions(spark, folder))
    return parts.select("question_id", F.col("sub_idx").cast("long").alias("sub_idx"), "sub_query")


@query(
    "embed_documents",
    f"""WITH {vector_sql('documents', 'doc_id', 'text', 'dv')}
SELECT doc_id AS chunk_id, sum(n)::BIGINT AS n_words, round(max(norm), 6) AS norm,
       sum(b * n)::BIGINT AS checksum FROM dv JOIN dv_norm USING (doc_id) GROUP BY doc_id""",
)
def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The offline default vectors of every document."""
    vectors = corpus(spark, folder)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    weighted = F.transform("vector", lambda x, place: x.cast("double") * place)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")).cast("long")
    return vectors.where(F.col("vector").isNotNull()).select(
        "chunk_id", total(F.col("vector")).alias("n_words"), F.round(F.sqrt(squares), 6).alias("norm"),
        total(weighted).alias("checksum"),
    )


@query(
    "pooled_hits",
    f"""WITH {HITS_SQL}
SELECT question_id, chunk_id, sub_idx::BIGINT AS sub_idx, rank, round(score, 6) AS score FROM hits
QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY sub_idx, rank) = 1""",
)
def pooled_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of all sub-queries, one row per question and chunk."""
    pooled = rt.pool(hits(spark, folder))
    return pooled.select(
        "question_id", "chunk_id", F.col("sub_idx").cast("long").alias("sub_idx"), F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"),
    )


@query(
    "retrieval_fallback",
    f"""WITH {HITS_SQL}, split_hits AS (SELECT * FROM hits WHERE sub_idx > 0)
SELECT question_id, chunk_id, sub_idx::BIGINT AS sub_idx, rank, round(score, 6) AS score FROM split_hits
UNION ALL
SELECT question_id, chunk_id, sub_idx, rank, round(score, 6) FROM hits
WHERE sub_idx = 0 AND question_id NOT IN (SELECT question_id FROM split_hits)""",
)
def retrieval_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Searching by parts only; where they find nothing the whole message counts."""
    every = hits(spark, folder)
    found = rt.with_fallback(questions(spark, folder), every.where("sub_idx > 0"), every.where("sub_idx = 0"), "question_id")
    return found.select(
        "question_id", "chunk_id", F.col("sub_idx").cast("long").alias("sub_idx"), F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"),
    )


def texted_hits(spark: SparkSession, folder: str) -> DataFrame:
    return hits(spark, folder).join(documents(spark, folder), "chunk_id")


CONTEXT_SQL = f"""{HITS_SQL},
blocks AS (
  SELECT question_id, sub_idx, 'Query: ' || any_value(sub_query) || chr(10) ||
         trim(string_agg({BLOCK_SQL}, {SEP_SQL} ORDER BY rank), {TRIM}) AS block
  FROM hits JOIN docs USING (chunk_id) GROUP BY question_id, sub_idx),
contexts AS (
  SELECT question_id, string_agg(block, {SEP_SQL} ORDER BY sub_idx) AS context FROM blocks GROUP BY question_id)"""


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    return rt.merge_context(rt.context_blocks(texted_hits(spark, folder)))


@query(
    "context_blocks",
    f"""WITH {CONTEXT_SQL}
SELECT question_id, length(context)::BIGINT AS n_chars, md5(context) AS digest FROM contexts""",
)
def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The whole context text of every question, as length and digest."""
    return contexts(spark, folder).select(
        "question_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest")
    )


TRIMMED_SQL = f"""pieces AS (
  SELECT question_id, context, i AS place, len(p) AS n_pieces, p[i] AS piece
  FROM (SELECT question_id, context, string_split(context, {SEP_SQL}) AS p FROM contexts), range(1, len(p) + 1) AS r(i)),
summed AS (
  SELECT *, sum(length(piece) + CASE WHEN place > 1 THEN 7 ELSE 0 END)
              OVER (PARTITION BY question_id ORDER BY place) AS used FROM pieces),
kept AS (
  SELECT question_id, any_value(context) AS context, count(*) FILTER (used <= {4 * CONTEXT_TOKENS}) AS n_kept,
         string_agg(piece, {SEP_SQL} ORDER BY place) FILTER (used <= {4 * CONTEXT_TOKENS}) AS front
  FROM summed GROUP BY question_id),
trimmed AS (
  SELECT question_id, CASE WHEN length(context) <= {4 * CONTEXT_TOKENS} THEN context
    WHEN n_kept = 0 THEN left(context, {4 * CONTEXT_TOKENS}) || chr(10) || '...[truncated]'
    ELSE front || chr(10) || '...[truncated]' END AS context FROM kept)"""


@query(
    "context_budget",
    f"""WITH {CONTEXT_SQL}, {TRIMMED_SQL}
SELECT question_id, length(context)::BIGINT AS n_chars, md5(context) AS digest FROM trimmed""",
)
def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts cut to a token budget at block borders."""
    blocks = F.split("context", rf"\Q{tx.BLOCK_SEPARATOR}\E", -1)
    cut = contexts(spark, folder).select("question_id", tx.trim_to_budget(blocks, CONTEXT_TOKENS).alias("context"))
    return cut.select("question_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


GERMAN_SQL = (
    "regexp_matches({0}, '[" + tx.GERMAN_LETTERS + "]') OR regexp_matches({0}, '(?i)\\b("
    + "|".join(w for w in tx.GERMAN_WORDS if w.isascii()) + ")\\b')"
)
REFUSED_SQL = f"""refused AS (
  SELECT q.question_id, q.message, CASE WHEN {GERMAN_SQL.format('message')} THEN 'de' ELSE 'en' END AS language,
         c.context IS NULL AS refused
  FROM questions q LEFT JOIN contexts c USING (question_id))"""


@query(
    "refusals",
    f"""WITH {CONTEXT_SQL}, {REFUSED_SQL}
SELECT question_id, language, refused,
       CASE WHEN NOT refused THEN NULL WHEN language = 'de' THEN '{an.REFUSALS["de"]}' ELSE '{an.REFUSALS["en"]}' END AS answer
FROM refused""",
)
def refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Questions without any context are refused in their language."""
    return rt.refuse(questions(spark, folder), contexts(spark, folder), answers=an.REFUSALS)


@query(
    "refusal_accuracy",
    f"""WITH {CONTEXT_SQL}, {REFUSED_SQL}
SELECT length(message) > 60 AS answerable, count(*)::BIGINT AS n,
       round(avg(CASE WHEN (length(message) > 60) <> refused THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM refused GROUP BY ALL""",
)
def refusal_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Long questions count as answerable; how often was refusing right?"""
    asked = questions(spark, folder)
    answers = rt.refuse(asked, contexts(spark, folder), answers=an.REFUSALS)
    cases = asked.select("question_id", (F.length("message") > 60).alias("answerable"))
    return ev.refusal_accuracy(cases, answers).withColumn("accuracy", F.round("accuracy", 6))


KEPT_HISTORY_TOKENS = 300
# A chat's turns as sent to a model, the newest first until the budget is spent; the first always stays.
PROMPTS_SQL = f"""model AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system' AND conv_id IN (SELECT question_id FROM contexts)
  UNION ALL
  SELECT conv_id, max(turn) + 1, 'user', max_by(text, turn) FILTER (role = 'user') FROM conversations
  WHERE role <> 'system' AND conv_id IN (SELECT question_id FROM contexts) GROUP BY conv_id HAVING max_by(role, turn) <> 'user'),
spent AS (
  SELECT *, sum(ceil(length(text) / 4.0)) OVER w AS used, row_number() OVER w AS place FROM model
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))"""


@query(
    "prompt_texts",
    f"""WITH {CONTEXT_SQL}, {TRIMMED_SQL}, {PROMPTS_SQL}
SELECT question_id AS conv_id, -1::BIGINT AS turn, 'system' AS role, md5('{an.SYSTEM_TEXT}' || chr(10) || chr(10) || 'Context:' || chr(10) || context) AS digest
FROM trimmed
UNION ALL
SELECT conv_id, turn, role, md5(text) FROM spent WHERE used <= {KEPT_HISTORY_TOKENS} OR place = 1""",
)
def prompt_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every message as it is sent, with the budgets of context and history at work."""
    ready = an.prompts(
        table(spark, folder, "conversations"), contexts(spark, folder), context_tokens=CONTEXT_TOKENS, history_tokens=KEPT_HISTORY_TOKENS
    )
    return ready.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "prompt_messages",
    f"""WITH {CONTEXT_SQL}
SELECT question_id AS conv_id, 'system' AS role, count(*)::BIGINT AS n FROM contexts GROUP BY question_id
UNION ALL
SELECT conv_id, role, count(*)::BIGINT FROM (
  SELECT conv_id, role FROM conversations WHERE role <> 'system' AND conv_id IN (SELECT question_id FROM contexts)
  UNION ALL
  SELECT conv_id, 'user' FROM conversations WHERE role <> 'system' AND conv_id IN (SELECT question_id FROM contexts)
  GROUP BY conv_id HAVING max_by(role, turn) <> 'user') GROUP BY conv_id, role""",
)
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the model-ready prompts, counted by role."""
    ready = an.prompts(table(spark, folder, "conversations"), contexts(spark, folder), history_tokens=100_000)
    return ready.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
