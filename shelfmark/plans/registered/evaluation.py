"""Scoring searches: metrics per query, means, comparisons, sweeps, gates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import fixed
from shelfmark.operators import metrics
from shelfmark.operators import rerank as rr
from shelfmark.operators import retrieval as rt
from shelfmark.operators.topk import rank_hits, score_topk, topk
from shelfmark.plans import evaluation as ev
from shelfmark.plans.registered import query, table
from shelfmark.plans.registered.search import CORPUS_SQL, cases, corpus, ranked_sql

KS = metrics.DEFAULT_K
LIMIT = ev.SEARCH_LIMIT
HALF = 32
RERANK_N = 10
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")

_IDCG = "list_sum([1.0::DOUBLE / log2(i + 1) FOR i IN range(1, least({n}, {k})::BIGINT + 1)])"


def per_query_sql(by: str, judged: str = "judged", name: str = "per_query") -> str:
    """Metrics from rows (by, rank, relevant, n_rel) in SQL."""
    sums, out = [], []
    for k in KS:
        inside = f"relevant AND rank <= {k}"
        sums.append(f"count(*) FILTER ({inside}) AS hits_{k}")
        sums.append(f"coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER ({inside}), 0) AS dcg_{k}")
        out.append(f"CASE WHEN n_ret > 0 THEN hits_{k} / least({k}, n_ret) ELSE 0 END AS precision_{k}")
        out.append(f"CASE WHEN n_rel > 0 THEN hits_{k} / n_rel ELSE 0 END AS recall_{k}")
        out.append(f"CASE WHEN n_rel > 0 THEN dcg_{k} / {_IDCG.format(n='n_rel', k=k)} ELSE 0 END AS ndcg_{k}")
    return f"""totals_{name} AS (
  SELECT {by}, sum(n_rel) AS n_rel, count(rank) AS n_ret, min(rank) FILTER (relevant) AS first, {', '.join(sums)}
  FROM {judged} GROUP BY {by}),
{name} AS (
  SELECT {by}, {', '.join(out)}, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS hit_rate,
         coalesce(1.0::DOUBLE / first, 0) AS rr
  FROM totals_{name})"""


def means_sql(by: str, source: str = "per_query") -> str:
    prefix = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {prefix}'{metric}' AS metric, {k}::BIGINT AS k, round(coalesce(avg({column}), 0), 6) AS value "
        f"FROM {source} {group}"
        for column, metric, k in metrics.metric_names(KS)
    ]
    return "\nUNION ALL ".join(parts)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


BESIDE_SQL = """relevant AS (
  SELECT q.query_id, c.chunk_id FROM cases q JOIN corpus c ON c.page_id = q.page_id AND abs(c.chunk_index - q.chunk_index) = 1)"""
BESIDE_JUDGED_SQL = f"""{ranked_sql('scored', 'hits', LIMIT, 'score >= 0.0 AND chunk_id <> query_id')},
{BESIDE_SQL},
judged AS (
  SELECT coalesce(h.query_id, r.query_id) AS query_id, h.rank, r.chunk_id IS NOT NULL AS relevant,
         CASE WHEN r.chunk_id IS NULL THEN 0 ELSE 1 END AS n_rel
  FROM hits h FULL JOIN relevant r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id)"""

_ROUNDED_SQL = ", ".join(f"round({c}, 6) AS {c}" for c, _, _ in metrics.metric_names(KS) if c != "hit_rate")


@query(
    "eval_per_query",
    f"""WITH {CORPUS_SQL}, {BESIDE_JUDGED_SQL}, {per_query_sql('query_id')}
SELECT query_id, {_ROUNDED_SQL}, hit_rate::BIGINT AS hit_rate FROM per_query""",
)
def eval_per_query(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks right before and after the query's own are relevant, as listed pairs."""
    chunks, asked = corpus(spark, folder), cases(spark, folder)
    hits = topk(chunks, asked.select("query_id", "vector"), LIMIT, threshold=0.0, skip_self=True)
    beside = F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")
    places = asked.select("query_id", "page_id", beside)
    relevant = chunks.join(places, ["page_id", "chunk_index"]).select("query_id", "chunk_id")
    result = metrics.per_query(metrics.judge_pairs(hits, relevant), KS)
    names = [c for c, _, _ in metrics.metric_names(KS) if c != "hit_rate"]
    return rounded(result, *names).withColumn("hit_rate", F.col("hit_rate").cast("long"))


def space_hits(spark: SparkSession, folder: str, width: int | None = None, limit: int = LIMIT,
               threshold: float = 0.0) -> DataFrame:
    """Hits with a relevance flag: a chunk of the query's own space is relevant."""
    chunks, asked = corpus(spark, folder), cases(spark, folder)
    cut = (lambda c: F.slice(c, 1, width)) if width else (lambda c: F.col(c))
    hits = topk(
        chunks.select("chunk_id", "space_key", cut("vector").alias("vector")),
        asked.select("query_id", cut("vector").alias("vector")),
        limit, threshold=threshold, skip_self=True, carry=("space_key",),
    )
    wanted = asked.select("query_id", F.col("space_key").alias("asked_space"))
    return hits.join(wanted, "query_id").withColumn("relevant", F.col("space_key") == F.col("asked_space"))


def space_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with their number of relevant chunks: their space's size, less themselves."""
    sizes = corpus(spark, folder).groupBy("space_key").agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    return cases(spark, folder).select("query_id", "space_key").join(sizes, "space_key")


SPACE_CASES_SQL = """space_cases AS (
  SELECT q.query_id, q.space_key, (SELECT count(*) - 1 FROM corpus c WHERE c.space_key = q.space_key) AS n_rel
  FROM cases q)"""


def space_judged_sql(hits: str = "hits", name: str = "judged", extra: str = "", cross: str = "") -> str:
    """Hits plus one row per case; ``extra`` names further grouping columns."""
    prefix = f"{extra}, " if extra else ""
    return f"""{name} AS (
  SELECT {prefix}query_id, rank, space_key = asked_space AS relevant, 0 AS n_rel FROM {hits}
  UNION ALL SELECT {prefix}query_id, NULL, false, n_rel FROM space_cases {cross})"""


SPACE_SQL = f"{CORPUS_SQL}, {SPACE_CASES_SQL}"
BASE_HITS_SQL = ranked_sql("scored", "hits", LIMIT, "score >= 0.0 AND chunk_id <> query_id")


@query(
    "eval_aggregate",
    f"""WITH {SPACE_SQL}, {BASE_HITS_SQL}, {space_judged_sql()}, {per_query_sql('query_id')}
{means_sql('')}""",
)
def eval_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Means of every metric; chunks of the query's own space are relevant."""
    judged = metrics.judge_classes(space_hits(spark, folder), space_cases(spark, folder))
    return rounded(metrics.aggregate(metrics.per_query(judged, KS), KS), "value")


@query(
    "eval_by_category",
    f"""WITH {SPACE_SQL}, {BASE_HITS_SQL}, {space_judged_sql()}, {per_query_sql('query_id')}
SELECT coalesce(space_key, 'all') AS category, count(*)::BIGINT AS n_queries, round(avg(precision_5), 6) AS precision_5,
       round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(rr), 6) AS mrr
FROM per_query JOIN space_cases USING (query_id) GROUP BY ROLLUP (space_key)""",
)
def eval_by_category(spark: SparkSession, folder: str) -> DataFrame:
    asked = space_cases(spark, folder)
    scores = metrics.per_query(metrics.judge_classes(space_hits(spark, folder), asked), KS)
    joined = scores.join(asked.select("query_id", "space_key"), "query_id")
    return joined.rollup("space_key").agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.round(F.avg(c), 6).alias(a) for c, a in
          (("precision_5", "precision_5"), ("recall_10", "recall_10"), ("ndcg_10", "ndcg_10"), ("rr", "mrr"))],
    ).select(F.coalesce("space_key", F.lit("all")).alias("category"), "n_queries", "precision_5", "recall_10", "ndcg_10", "mrr")


THRESHOLDS = (0.0, 0.1, 0.2, 0.3)


@query(
    "threshold_sweep",
    f"""WITH {SPACE_SQL}, {BASE_HITS_SQL}, steps AS (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS threshold),
cut AS (SELECT * FROM hits JOIN steps ON score >= threshold),
{space_judged_sql('cut', extra='threshold', cross='CROSS JOIN steps')}, {per_query_sql('threshold, query_id')}
{means_sql('threshold')}""",
)
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """One search serves every threshold."""
    cut = ev.with_thresholds(space_hits(spark, folder, threshold=min(THRESHOLDS)), THRESHOLDS)
    steps = F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold")
    asked = space_cases(spark, folder).select("*", steps)
    by = ("threshold", "query_id")
    scores = metrics.per_query(metrics.judge_classes(cut, asked, by), KS, by)
    return rounded(metrics.aggregate(scores, KS, ("threshold",)), "value")


def texted_hits(spark: SparkSession, folder: str, width: int | None = None) -> DataFrame:
    """Hits with query and chunk text; the text of a chunk is the document of the same number, if any."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return space_hits(spark, folder, width).join(texts, "chunk_id", "left").join(asked, "query_id")


def lexical_sql(hits: str = "hits", name: str = "lexical", extra: str = "") -> str:
    """Second scores of hits by shared words, in SQL."""
    prefix = f"{extra}, " if extra else ""
    return f"""{name} AS (
  SELECT {prefix}h.query_id, h.chunk_id, h.space_key, h.asked_space, h.score AS first_score, h.rank AS first_rank,
         round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '\\S+')),
                            list_distinct(regexp_extract_all(lower(d.text), '\\S+'))))
               / len(list_distinct(regexp_extract_all(lower(b.text), '\\S+'))), 9) AS score
  FROM {hits} h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id)"""


def stages_sql(extra: str = "") -> str:
    """Hits of both stages from ``hits`` and ``reranked`` as ``staged``."""
    prefix = f"{extra}, " if extra else ""
    return f"""staged AS (
  SELECT {prefix}'base' AS stage, query_id, rank, space_key, asked_space FROM hits
  UNION ALL SELECT {prefix}'reranked', query_id, rank, space_key, asked_space FROM reranked WHERE score >= 0.3)"""


@query(
    "rerank_topn",
    f"""WITH {CORPUS_SQL}, {BASE_HITS_SQL}, {lexical_sql()}, {ranked_sql('lexical', 'reranked', RERANK_N)}
SELECT query_id, chunk_id, first_rank, round(score, 6) AS rerank_score, rank AS rerank_rank FROM reranked WHERE score >= 0.3""",
)
def rerank_topn(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates reordered by shared words: the best ten first, then the threshold."""
    hits = texted_hits(spark, folder)
    kept = rt.rerank(hits, rt.lexical_score(F.col("query"), F.col("content")), top_n=RERANK_N, threshold=0.3)
    return kept.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("first_rank"),
        F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank_rank").cast("long").alias("rerank_rank"),
    )


@query(
    "rerank_fallback",
    f"""WITH {CORPUS_SQL}, {BASE_HITS_SQL}, {lexical_sql()},
marked AS (
  SELECT l.*, bool_or(d.lang = 'es') OVER (PARTITION BY query_id) AS used_base,
         row_number() OVER (PARTITION BY query_id
           ORDER BY CASE WHEN d.lang = 'es' THEN NULL ELSE score END DESC NULLS LAST, chunk_id) AS place
  FROM lexical l JOIN documents d ON d.doc_id = l.chunk_id)
SELECT query_id, chunk_id, used_base, CASE WHEN used_base THEN first_rank ELSE place END AS final_rank
FROM marked WHERE used_base OR (place <= {RERANK_N} AND score >= 0.3)""",
)
def rerank_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A scorer that fails on Spanish texts: such queries keep their first order."""
    langs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    hits = texted_hits(spark, folder).join(langs, "chunk_id")
    failed = F.col("lang") == "es"
    score = F.round(rt.lexical_score(F.col("query"), F.col("content")), 9)
    scored = hits.withColumn("error", F.when(failed, "language not supported")).withColumn(
        "rerank_score", F.when(~failed, score)
    )
    final = rt.rerank_or_base(scored, top_n=RERANK_N, threshold=0.3)
    return final.select("query_id", "chunk_id", "used_base", F.col("final_rank").cast("long").alias("final_rank"))


class WordReranker:
    """A list-wise model: shares of the query's words; it refuses some queries, skips short texts and makes up an id."""

    def __call__(self, query: str, candidates: Sequence[tuple[object, str]]) -> list[tuple[object, float]]:
        asked = set(_WORD.findall(query.lower()))
        if len(asked) % 7 == 0:
            raise ValueError("query refused")
        found = [(i, len(asked & set(_WORD.findall(text.lower()))) / len(asked)) for i, text in candidates if len(text) >= 200]
        return [(-1, 2.0), *sorted(found, key=lambda f: -f[1])]


MODEL_SQL = f"""WITH {CORPUS_SQL}, {BASE_HITS_SQL}, {lexical_sql()},
judged AS (
  SELECT l.*, len(list_distinct(regexp_extract_all(lower(b.text), '\\S+'))) % 7 = 0 AS used_base,
         CASE WHEN length(d.text) >= 200 THEN l.score END AS own
  FROM lexical l JOIN documents d ON d.doc_id = l.chunk_id JOIN benchmark b ON b.item_id = l.query_id)"""


def model_candidates(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"))
    return texted_hits(spark, folder).join(known, "chunk_id", "left_semi").select("query_id", "chunk_id", "rank", "query", "content")


@query(
    "rerank_model",
    f"""{MODEL_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC NULLS LAST, chunk_id) AS place FROM judged)
SELECT query_id, chunk_id, used_base, CASE WHEN used_base THEN first_rank ELSE place END AS final_rank
FROM placed WHERE used_base OR (place <= {RERANK_N} AND own >= 0.3)""",
)
def rerank_model(spark: SparkSession, folder: str) -> DataFrame:
    """A model sees each query with all its candidates; what it makes up is dropped, what it refuses keeps its first order."""
    final = rr.rerank_by_model(model_candidates(spark, folder), WordReranker, top_n=RERANK_N, threshold=0.3)
    return final.select("query_id", "chunk_id", "used_base", F.col("final_rank").cast("long").alias("final_rank"))


@query(
    "rerank_outcomes",
    f"""{MODEL_SQL}
SELECT query_id, count(*) FILTER (NOT used_base AND own IS NOT NULL) AS scored,
       count(*) FILTER (NOT used_base AND own IS NULL) AS unscored, count(*) FILTER (used_base) AS failed
FROM judged GROUP BY query_id""",
)
def rerank_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every candidate that was shown to the model, in lists of eight."""
    return rr.outcomes(rr.score_lists(model_candidates(spark, folder), WordReranker, list_rows=8))


def staged_scores(hits: DataFrame, asked: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per-query metrics of both stages."""
    config = by[:-1]
    staged = ev.with_rerank_stage(
        hits, rt.lexical_score(F.col("query"), F.col("content")), top_n=RERANK_N, threshold=0.3, by=(*config, "query_id")
    )
    stages = asked.select("*", F.explode(F.array(F.lit("base"), F.lit("reranked"))).alias("stage"))
    keys = (*config, "stage", "query_id")
    return metrics.per_query(metrics.judge_classes(staged, stages, keys), KS, keys)


@query(
    "eval_rerank_lift",
    f"""WITH {SPACE_SQL}, {BASE_HITS_SQL}, {lexical_sql()}, {ranked_sql('lexical', 'reranked', RERANK_N)}, {stages_sql()},
stages AS (SELECT unnest(['base', 'reranked']) AS stage),
{space_judged_sql('staged', extra='stage', cross='CROSS JOIN stages')}, {per_query_sql('stage, query_id')},
means AS ({means_sql('stage')})
SELECT b.metric, b.k, b.value AS before, r.value AS after, round(r.value - b.value, 6) AS lift
FROM means b JOIN means r ON r.metric = b.metric AND r.k = b.k AND b.stage = 'base' AND r.stage = 'reranked'""",
)
def eval_rerank_lift(spark: SparkSession, folder: str) -> DataFrame:
    scores = staged_scores(texted_hits(spark, folder), space_cases(spark, folder), ("query_id",))
    means = rounded(metrics.aggregate(scores, KS, ("stage",)), "value")
    return rounded(metrics.lift(means), "lift")


CONFIGS = {"full": 64, "half": HALF}


def config_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of every configuration, whole vectors and their first half, with texts: one search, and one join with each table."""
    asked = cases(spark, folder)
    configs = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), F.lit(width).alias("width")) for name, width in CONFIGS.items()])).alias("c")
    probes = asked.select("query_id", "vector", configs).select(
        F.concat_ws("/", "c.config", "query_id").alias("query_id"), F.struct("vector", "c.width").alias("probe")
    )
    chunks = corpus(spark, folder).select("chunk_id", "space_key", F.col("vector").alias("probe"))
    # One hit more than is wanted, as a query may find itself.
    found = score_topk(chunks, probes, LIMIT + 1, field="probe", threshold=0.0, carry=("space_key",))
    place = F.split("query_id", "/")
    named = found.select(place[0].alias("config"), place[1].cast("long").alias("query_id"), "chunk_id", "score", "space_key")
    hits = rank_hits(named.where("chunk_id != query_id"), LIMIT, ("config", "query_id"))
    wanted = asked.select("query_id", F.col("space_key").alias("asked_space"), "query")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    judged = hits.join(wanted, "query_id").withColumn("relevant", F.col("space_key") == F.col("asked_space"))
    return judged.join(texts, "chunk_id", "left")


CONFIG_SQL = f"""{SPACE_SQL},
configs AS (SELECT unnest({list(CONFIGS)}) AS config),
scored_all AS (
  SELECT 'full' AS config, query_id, chunk_id, asked_space, space_key, score FROM scored
  UNION ALL
  SELECT 'half', q.query_id, c.chunk_id, q.space_key, c.space_key,
         round(list_cosine_similarity(q.vector[1:{HALF}], c.vector[1:{HALF}]), 9)
  FROM cases q CROSS JOIN corpus c),
{ranked_sql('scored_all', 'hits', LIMIT, 'score >= 0.0 AND chunk_id <> query_id', 'config, query_id')},
{lexical_sql(extra='config')}, {ranked_sql('lexical', 'reranked', RERANK_N, by='config, query_id')}, {stages_sql('config')},
stages AS (SELECT unnest(['base', 'reranked']) AS stage),
{space_judged_sql('staged', extra='config, stage', cross='CROSS JOIN stages CROSS JOIN configs')},
{per_query_sql('config, stage, query_id')},
staged_means AS ({means_sql('config, stage')}),
means AS (
  SELECT CASE WHEN stage = 'base' THEN config ELSE config || ' + rerank' END AS config, metric, k, value FROM staged_means)"""


def config_means(spark: SparkSession, folder: str) -> DataFrame:
    asked = space_cases(spark, folder).select("*", F.explode(F.array(*[F.lit(c) for c in CONFIGS])).alias("config"))
    scores = staged_scores(config_hits(spark, folder), asked, ("config", "query_id"))
    means = rounded(metrics.aggregate(scores, KS, ("config", "stage")), "value")
    label = F.when(F.col("stage") == "base", F.col("config")).otherwise(F.concat("config", F.lit(" + rerank")))
    return means.select(label.alias("config"), "metric", "k", "value")


@query("ab_compare", f"WITH {CONFIG_SQL} SELECT * FROM means")
def ab_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Two vector widths, each with and without reranking, in one job."""
    return config_means(spark, folder)


@query(
    "ab_winners",
    f"""WITH {CONFIG_SQL}, best AS (SELECT metric, k, max(value) AS best FROM means GROUP BY metric, k)
SELECT config, metric, k, value, value = best AS is_best,
       CASE WHEN value = best THEN printf('**%.4f**', value) ELSE printf('%.4f', value) END AS cell
FROM means JOIN best USING (metric, k)""",
)
def ab_winners(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.winners(config_means(spark, folder))


@query(
    "regression_gate",
    f"""WITH {SPACE_SQL},
half AS (
  SELECT q.query_id, c.chunk_id, q.space_key AS asked_space, c.space_key,
         round(list_cosine_similarity(q.vector[1:{HALF}], c.vector[1:{HALF}]), 9) AS score
  FROM cases q CROSS JOIN corpus c),
{BASE_HITS_SQL}, {space_judged_sql()}, {per_query_sql('query_id')},
{ranked_sql('half', 'half_hits', LIMIT, 'score >= 0.0 AND chunk_id <> query_id')},
{space_judged_sql('half_hits', 'half_judged')}, {per_query_sql('query_id', 'half_judged', 'half_per_query')},
baseline AS ({means_sql('')}), run AS ({means_sql('', 'half_per_query')})
SELECT metric, k, r.value, b.value AS baseline, round(b.value - r.value, 6) AS drop, b.value - r.value > 0.002 AS failed
FROM run r JOIN baseline b USING (metric, k)""",
)
def regression_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Half-width vectors against the full ones: what fell by more than 0.002."""
    asked = space_cases(spark, folder)

    def means(width: int | None) -> DataFrame:
        scores = metrics.per_query(metrics.judge_classes(space_hits(spark, folder, width), asked), KS)
        return rounded(metrics.aggregate(scores, KS), "value")

    return rounded(metrics.regressions(means(HALF), means(None), 0.002), "drop")


@query(
    "regression_gate_missing",
    f"""WITH {SPACE_SQL}, {BASE_HITS_SQL}, {space_judged_sql()}, {per_query_sql('query_id')},
baseline AS ({means_sql('')}), run AS (SELECT * FROM baseline WHERE NOT (metric = 'recall' AND k = 5))
SELECT metric, k, r.value, b.value AS baseline, round(b.value - r.value, 6) AS drop, r.value IS NULL OR b.value - r.value > 0.002 AS failed
FROM baseline b LEFT JOIN run r USING (metric, k)""",
)
def regression_gate_missing(spark: SparkSession, folder: str) -> DataFrame:
    """A metric that the run lacks fails the gate."""
    scores = metrics.per_query(metrics.judge_classes(space_hits(spark, folder, None), space_cases(spark, folder)), KS)
    means = rounded(metrics.aggregate(scores, KS), "value")
    return rounded(metrics.regressions(means.where("NOT (metric = 'recall' AND k = 5)"), means, 0.002), "drop")


@query(
    "eval_report",
    f"""WITH {SPACE_SQL}, {BASE_HITS_SQL}, {space_judged_sql()}, {per_query_sql('query_id')}, means AS ({means_sql('')})
SELECT p.k, printf('| %d | %.4f | %.4f | %.4f |', p.k, p.value, r.value, n.value) AS line
FROM means p JOIN means r ON r.k = p.k AND r.metric = 'recall' JOIN means n ON n.k = p.k AND n.metric = 'ndcg'
WHERE p.metric = 'precision'""",
)
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report's table, one line per k."""
    means = eval_aggregate(spark, folder).where(F.col("k") > 0)
    wide = means.groupBy("k").pivot("metric", ["precision", "recall", "ndcg"]).agg(F.first("value"))
    cells = [F.col("k").cast("string"), *[fixed(F.col(m), 4) for m in ("precision", "recall", "ndcg")]]
    return wide.select("k", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
