"""JSON records: audit events, model replies, rich text, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import records as rc
from shelfmark.plans.registered import query, table


@query(
    "audit_events_parse",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'retrieval' WHEN 'assistant' THEN 'classification' END AS type,
  'conv-' || conv_id AS request_id,
  CASE WHEN role = 'user' THEN CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '…' END END AS query,
  CASE WHEN role = 'assistant' THEN CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '…' END END AS reasoning,
  CASE WHEN role = 'user' THEN turn END AS result_count
FROM conversations WHERE role <> 'system'""",
)
def audit_events_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as log lines of several kinds; system turns are of no known kind."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    line = F.to_json(
        F.struct(
            F.when(user, "retrieval").when(assistant, "classification").otherwise("debug").alias("type"),
            F.concat(F.lit("conv-"), F.col("conv_id")).alias("requestId"),
            F.when(user, F.col("text")).alias("query"), F.when(assistant, F.col("text")).alias("reasoning"),
            F.when(user, F.col("turn")).alias("resultCount"), F.lit("x").alias("unknownField"),
        )
    )
    parsed = rc.audit_events(table(spark, folder, "conversations").select("conv_id", "turn", line.alias("line")))
    return parsed.select(
        "conv_id", "turn", "type", F.col("requestId").alias("request_id"), "query", "reasoning",
        F.col("resultCount").alias("result_count"),
    )


@query(
    "audit_redact",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN '[REDACTED]' END AS "authorization",
  CASE WHEN event_type = 'click' THEN '[REDACTED]' END AS header, CASE WHEN event_type = 'click' THEN 'host-' || user_id END AS host,
  CASE WHEN event_type = 'error' THEN '[REDACTED]' END AS llm_key, event_type AS msg FROM events""",
)
def audit_redact(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets on the known paths are replaced, everything else stays."""
    kind = F.col("event_type")
    line = F.to_json(
        F.struct(
            F.when(kind != "view", F.concat(F.lit("Bearer "), "event_id")).alias("authorization"),
            F.when(kind == "click", F.struct(
                F.struct(F.lit("secret").alias("authorization"), F.concat(F.lit("host-"), F.col("user_id")).alias("host")).alias("headers")
            )).alias("req"),
            F.when(kind == "error", F.struct(F.lit("key").alias("apiKey"), F.lit("m").alias("model"))).alias("llm"),
            kind.alias("msg"),
        )
    )
    events = table(spark, folder, "events").select("event_id", F.from_json(line, rc.SECRET_SHAPE).alias("r"))
    clean = events.select("event_id", rc.redact(F.col("r")).alias("r"))
    return clean.select(
        "event_id", "r.authorization", F.col("r.req.headers.authorization").alias("header"), F.col("r.req.headers.host").alias("host"),
        F.col("r.llm.apiKey").alias("llm_key"), "r.msg",
    )


CALLS_SQL = """calls AS (
  SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'claude-x' WHEN 'click' THEN 'gpt-y' WHEN 'error' THEN 'o3-z'
      WHEN 'purchase' THEN 'gemini-w' ELSE 'other' END AS model,
    CASE WHEN event_type <> 'error' THEN (props->>'$.k')::BIGINT END AS input_tokens,
    CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS output_tokens, event_type AS finish_reason FROM events)"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Events as model calls; errors report no usage."""
    kind = F.col("event_type")
    model = F.when(kind == "view", "claude-x").when(kind == "click", "gpt-y").when(kind == "error", "o3-z").when(
        kind == "purchase", "gemini-w").otherwise("other")
    ok = kind != "error"
    return table(spark, folder, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), model.alias("model"),
        F.when(ok, F.get_json_object("props", "$.k").cast("long")).alias("input_tokens"),
        F.when(ok, F.floor("value").cast("long")).alias("output_tokens"), kind.alias("finish_reason"),
    )


@query(
    "token_usage",
    f"""WITH {CALLS_SQL}
SELECT user_id AS request_id, CASE WHEN model LIKE 'claude-%' THEN 'anthropic' WHEN model LIKE 'gpt-%' OR model LIKE 'o3%' THEN 'openai'
    WHEN model LIKE 'gemini-%' THEN 'gemini' END AS provider,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*)::BIGINT AS n_calls,
  (coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0))::BIGINT AS total_tokens
FROM calls GROUP BY ALL""",
)
def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    by_provider = calls(spark, folder).withColumn("provider", rc.provider_of(F.col("model")))
    return rc.token_usage(by_provider, ("request_id", "provider"))


@query(
    "finish_reasons",
    f"""WITH {CALLS_SQL}, seen AS (SELECT user_id, finish_reason, min(event_id) AS first FROM calls GROUP BY ALL)
SELECT user_id AS request_id, string_agg(finish_reason, ',' ORDER BY first) AS reasons FROM seen GROUP BY user_id""",
)
def finish_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return rc.finish_reasons(calls(spark, folder)).select("request_id", F.array_join("finish_reasons", ",").alias("reasons"))


@query(
    "parse_llm_json",
    """WITH rows_in AS (SELECT event_id, event_type, 'q' || user_id AS q, (props->>'$.k')::INT AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'no JSON found' WHEN k < 10 THEN 'question or rationale missing'
    WHEN k < 20 AND event_type <> 'click' THEN 'questions must be a non-empty array' WHEN k < 25 AND event_type <> 'click' THEN 'question or rationale missing' END AS error,
  CASE WHEN event_type = 'error' OR k < 10 OR (k < 25 AND event_type <> 'click') THEN NULL
       WHEN event_type = 'click' OR k < 60 THEN q ELSE q || ',' || q || '-2' END AS questions FROM rows_in""",
)
def parse_llm_json(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies in all the shapes they come in; at most two questions are kept."""
    q = F.concat(F.lit("q"), F.col("user_id"))
    k = F.get_json_object("props", "$.k").cast("int")

    def one(question: F.Column) -> F.Column:
        text = F.when(k < 10, F.lit(" ")).otherwise(F.concat(F.lit(" "), question))
        return F.concat(F.lit('{"question": "'), text, F.lit('", "rationale": "because"}'))

    unreasoned = F.concat(F.lit('{"question": "'), q, F.lit('", "rationale": 5}'))
    second, third = one(F.concat(q, F.lit("-2"))), one(F.concat(q, F.lit("-3")))
    listed = (
        F.when(k < 10, one(q)).when(k < 20, F.lit("")).when(k < 25, unreasoned).when(k < 60, one(q))
        .otherwise(F.concat_ws(", ", one(q), second, third))
    )
    several = F.concat(F.lit('{"questions": ['), listed, F.lit("]}"))
    reply = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), several, F.lit("\n```")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Here you are: "), several, F.lit(" Good luck.")))
        .when(F.col("event_type") == "click", one(q))
        .when(F.col("event_type") == "error", F.lit("I cannot help with that."))
        .otherwise(several)
    )
    parsed = table(spark, folder, "events").select("event_id", rc.parse_model_reply(reply, 2).alias("r"))
    return parsed.select(
        "event_id", F.col("r.error").alias("error"),
        F.array_join(F.transform("r.questions", lambda x: x["question"]), ",").alias("questions"),
    )


@query(
    "adf_to_text",
    """WITH flat AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN text
    ELSE '# ' || chr(10) || 'From ' || role || ' again' || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '• x' END AS t FROM conversations)
SELECT conv_id, turn, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM flat""",
)
def adf_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as document trees with headings, breaks and lists; system turns as plain text."""

    def leaf(text: F.Column) -> F.Column:
        return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("array<struct<type: string>>").alias("content"))

    line_break = F.struct(F.lit("hardBreak").alias("type"), F.lit(None).cast("string").alias("text"),
                          F.lit(None).cast("array<struct<type: string>>").alias("content"))

    def block(kind: str, *children: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("type"), F.array(*children).alias("content"))

    paragraphs = F.transform(F.split("text", "\n", -1), lambda line: block("paragraph", leaf(line), line_break))
    tree = F.struct(
        F.lit("doc").alias("type"),
        F.concat(
            F.array(block("heading", leaf(F.lit("# ")))),
            F.array(block("paragraph", leaf(F.concat(F.lit("From "), "role")), leaf(F.lit(" again")))),
            paragraphs,
            F.array(block("listItem", leaf(F.lit("• x")))),
        ).alias("content"),
    )
    document = F.when(F.col("role") == "system", F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)).otherwise(
        F.to_json(tree)
    )
    flat = table(spark, folder, "conversations").select("conv_id", "turn", rc.rich_text(document).alias("t"))
    return flat.select("conv_id", "turn", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))
