"""JSON records: audit events, model replies, rich text, model usage."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx

# One wide shape for every kind of audit event; unused fields stay null.
AUDIT = (
    "type string, agent string, issueKey string, requestId string, sessionId string, trigger string, "
    "clarificationRounds bigint, path string, confidence double, language string, retrievalRounds bigint, "
    "reasoning string, coercedFrom string, resultCount bigint, topScore double, strong boolean, query string, "
    "chunks array<struct<id: string, score: double, url: string, title: string>>, purpose string, "
    "provider string, model string, inputTokens bigint, outputTokens bigint, finishReason string, "
    "durationMs bigint, action string, detail string, skipped boolean, cacheKey string"
)
# The kinds of audit events, and fields that hold secrets.
AUDIT_TYPES = (
    "request", "retrieval", "llm-call", "ticket-event", "classification", "cache-lookup", "jira-action", "cache-write",
)
REDACTED = "[REDACTED]"
# Model id prefixes of the providers.
PROVIDER_PREFIXES = {"anthropic": ("claude-",), "openai": ("gpt-", "o1", "o3", "o4"), "gemini": ("gemini-",)}


def audit_events(lines: DataFrame, column: str = "line", limit: int = 200) -> DataFrame:
    """Typed audit events; query and reasoning texts are shortened for the log."""
    rest = [c for c in lines.columns if c != column]
    parsed = lines.select(*rest, F.from_json(column, AUDIT).alias("e")).select(*rest, "e.*")
    known = parsed.where(F.col("type").isin(*AUDIT_TYPES))
    return known.withColumns(
        {name: tx.truncate_for_log(F.col(name), limit) for name in ("query", "reasoning")}
    )


SECRET_SHAPE = (
    "type string, authorization string, apiKey string, "
    "req struct<headers: struct<authorization: string, host: string>, apiKey: string>, "
    "llm struct<apiKey: string, model: string>, msg string"
)


def redact(record: Column, *, top: Sequence[str] = ("authorization", "apiKey"),
           nested: Sequence[str] = ("req", "llm")) -> Column:
    """Replace secrets on the known paths of a typed record where they are set."""

    def hide(value: Column) -> Column:
        return F.when(value.isNotNull(), F.lit(REDACTED))

    for name in top:
        record = record.withField(name, hide(record[name]))
    for name in nested:
        inner = record[name].withField("apiKey", hide(record[name]["apiKey"]))
        if name == "req":
            headers = record["req"]["headers"]
            inner = inner.withField("headers", headers.withField("authorization", hide(headers["authorization"])))
        record = record.withField(name, F.when(record[name].isNotNull(), inner))
    return record


def provider_of(model: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for provider, prefixes in PROVIDER_PREFIXES.items():
        starts = F.lit(False)
        for prefix in prefixes:
            starts = starts | model.startswith(prefix)
        chosen = F.when(starts, F.lit(provider)).otherwise(chosen)
    return chosen


def token_usage(calls: DataFrame, by: Sequence[str] = ("request_id",)) -> DataFrame:
    """Tokens per run; calls without usage add nothing. Also finish reasons by first sight."""
    summed = calls.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count(F.lit(1)).alias("n_calls"),
    )
    return summed.withColumn(
        "total_tokens", F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    )


def finish_reasons(calls: DataFrame, by: Sequence[str] = ("request_id",), order: str = "seq") -> DataFrame:
    """Distinct finish reasons in the order they first appeared.

    Reasons are reduced to one row each before they are listed.
    """
    seen = calls.where(F.col("finish_reason").isNotNull()).groupBy(*by, "finish_reason").agg(F.min(order).alias("__at"))
    listed = seen.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", "finish_reason"))).alias("__r"))
    return listed.select(*by, F.transform("__r", lambda r: r["finish_reason"]).alias("finish_reasons"))


def parse_model_reply(reply: Column, most: int | None = None) -> Column:
    """Questions from a model's reply as struct(questions, error).

    A code fence around the JSON is removed; failing that, the widest ``{...}``
    span is tried. A single object counts as a list of one.
    """
    trimmed = tx.strip(reply)
    fence = r"(?i)\A```(?:json)?\s*([\s\S]*?)\s*```\z"
    candidate = F.when(trimmed.rlike(fence), tx.strip(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)
    span = F.regexp_extract(candidate, r"(\{[\s\S]*\})", 1)
    parsed = F.coalesce(F.try_parse_json(candidate), F.try_parse_json(F.nullif(span, F.lit(""))))
    return tx.let(parsed, lambda document: _questions(document, most))


def _questions(parsed: Column, most: int | None) -> Column:
    def kind(value: Column) -> Column:
        return F.schema_of_variant(value)

    def field(item: Column, name: str) -> Column:
        value = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(kind(value) == "STRING", tx.strip(F.try_variant_get(item, f"$.{name}", "string")))

    def entry(item: Column) -> Column:
        return F.struct(field(item, "question").alias("question"), field(item, "rationale").alias("rationale"))

    listed = F.try_variant_get(parsed, "$.questions", "variant")
    items = F.when(listed.isNotNull(), F.try_variant_get(parsed, "$.questions", "array<variant>")).otherwise(
        F.array(parsed)
    )

    def check(questions: Column) -> Column:
        broken = F.exists(
            questions,
            lambda q: (F.coalesce(F.length(q["question"]), F.lit(0)) == 0) | q["rationale"].isNull(),
        )
        error = (
            F.when(parsed.isNull(), "no JSON found")
            .when(~kind(parsed).startswith("OBJECT"), "not a JSON object")
            .when(questions.isNull() | (F.size(questions) == 0), "questions must be a non-empty array")
            .when(broken, "question or rationale missing")
        )
        kept = F.slice(questions, 1, most) if most else questions
        return F.struct(F.when(error.isNull(), kept).alias("questions"), error.alias("error"))

    return tx.let(F.transform(items, entry), check)


# Rich-text nodes that end a line.
LINE_NODES = ("paragraph", "heading", "listItem", "codeBlock", "blockquote", "tableRow")


def tree_text(tree: dict) -> str:
    """Text of a document tree, in reading order; any depth."""
    out: list[str] = []
    todo: list[object] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, dict):
            kind = node.get("type")
            if kind == "hardBreak":
                out.append("\n")
                continue
            if kind == "text":
                out.append(node.get("text") or "")
            if kind in LINE_NODES:
                todo.append("\n")
            todo.extend(reversed([child for child in node.get("content") or () if isinstance(child, dict)]))
    return "".join(out)


def rich_text(document: Column) -> Column:
    """Plain text of a description that is a JSON document tree or a plain string.

    The tree is read by Arrow-batched Python, cleaning up stays in the JVM.
    """

    @F.pandas_udf("string")
    def flatten(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> str:
            if value is None:
                return ""
            try:
                tree = json.loads(value)
            except ValueError:
                return value
            if isinstance(tree, dict):
                return tree_text(tree)
            return tree if isinstance(tree, str) else ""

        return values.map(one)

    return tx.strip(F.regexp_replace(flatten(document), r"\n{3,}", "\n\n"))
