"""Ticket triage for whole batches: rules, routes, overrides, action plans."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fixed, is_probably_german, whole_word
from shelfmark.operators.spread import join_parts

# Limits of the decision rules.
CONFIDENCE_FLOOR = 0.4
CACHE_WRITE_CONFIDENCE = 0.6
MAX_CLARIFICATIONS = 2
MAX_RETRIEVALS = 1

DEFAULT_MARKER = "[agent:clarification]"


@dataclass(frozen=True)
class Rule:
    """A reply that needs no model: an id, when it applies, and what it says."""

    rule_id: str
    applies: Column
    reply: Column
    transition: str | None = None
    to_reporter: bool = False


def access_request_rule(issue_type: Column, summary: Column, description: Column,
                        reply_de: str = "Bitte Zielsystem, Rolle, Genehmigung und Zeitraum angeben.",
                        reply_en: str = "Please state the target system, role, approver and duration.") -> Rule:
    """Requests for access always need the same details first."""
    # The words that make a request one for access.
    words = "zugriff|berechtigung|access|permission"
    applies = issue_type.rlike("(?i)service request") & summary.rlike(f"(?i){whole_word(words)}")
    german = is_probably_german(F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))
    reply = F.when(german, F.lit(reply_de)).otherwise(F.lit(reply_en))
    return Rule("access-request", F.coalesce(applies, F.lit(False)), reply, "waiting-for-reporter", True)


def check_rules(rules: Sequence[Rule]) -> None:
    names = [rule.rule_id for rule in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"rule ids must be unique: {names}")


def first_rule(rules: Sequence[Rule], pick: str = "rule_id") -> Column:
    """Id, reply or transition of the first rule that applies; null if none does."""
    check_rules(rules)
    chosen: Column | None = None
    for rule in rules:
        value = getattr(rule, pick)
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(rule.applies, value) if chosen is None else chosen.when(rule.applies, value)
    return chosen if chosen is not None else F.lit(None).cast("string")


def clarification_rounds(tickets: DataFrame, comments: DataFrame, agent: str, marker: str = DEFAULT_MARKER) -> DataFrame:
    """Adds how often the agent has already asked back, counted from its comments."""
    own = comments.where((F.col("author") == agent) & F.col("body").contains(marker))
    counts = own.groupBy("ticket_key").agg(F.count(F.lit(1)).alias("__n"))
    joined = tickets.join(counts, "ticket_key", "left")
    return joined.withColumn("clarification_rounds", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")


def overrides(path: Column, confidence: Column, hits: Column, retrievals: Column, clarifications: Column,
              has_context: Column) -> Column:
    """Hard rules over a proposed path; the order of the three steps matters."""
    cached = F.when((path == "use_cache") & (hits == 0), "need_context").otherwise(path)
    evidence = has_context | (hits > 0)
    concluded = F.when(evidence | (clarifications >= MAX_CLARIFICATIONS), "answer").otherwise("ask_reporter")
    spent = F.when((cached == "need_context") & (retrievals >= MAX_RETRIEVALS), concluded).otherwise(cached)
    return F.when(confidence < CONFIDENCE_FLOOR, "escalate").otherwise(spent)


def first_step(clarifications: Column, rule_id: Column) -> Column:
    """Where a ticket goes before any model is asked."""
    return (
        F.when(clarifications >= MAX_CLARIFICATIONS, "escalate")
        .when(rule_id.isNotNull(), "handler")
        .otherwise("classify")
    )


def next_step(path: Column) -> Column:
    return (
        F.when(path.isin("use_cache", "answer"), "compose_answer")
        .when(path == "need_context", "retrieve_context")
        .when(path == "ask_reporter", "compose_clarification")
        .otherwise("compose_escalation")
    )


def outcome(step: Column, path: Column) -> Column:
    """What a ticket's run ends with; null while another step is due."""
    return (
        F.when(step == "handler", "handler")
        .when(step == "escalate", "escalated")
        .when(path == "use_cache", "cached")
        .when(path == "answer", "answered")
        .when(path == "ask_reporter", "clarification")
        .when(path == "need_context", F.lit(None))
        .otherwise("escalated")
    )


def action_plan(result: Column, reporter: Column, *, rule_transition: Column | None = None,
                rule_to_reporter: Column | None = None) -> Column:
    """Ordered actions as an array of (type, arg) for an outcome."""

    def action(kind: str, arg: Column | str | None) -> Column:
        value = arg if isinstance(arg, Column) else F.lit(arg).cast("string")
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("arg"))

    comment = action("addComment", None)
    back = F.when(reporter.isNotNull(), action("assignIssue", reporter))
    rule_move = rule_transition if rule_transition is not None else F.lit(None).cast("string")
    rule_back = rule_to_reporter if rule_to_reporter is not None else F.lit(False)
    return F.array_compact(
        F.when(result.isin("answered", "cached"), F.array(comment, action("transition", "resolve")))
        .when(result == "clarification", F.array(comment, action("transition", "waiting-for-reporter"), back))
        .when(
            result == "handler",
            F.array(comment, F.when(rule_move.isNotNull(), action("transition", rule_move)), F.when(rule_back, back)),
        )
        .otherwise(F.array(comment))
    )


def describe_actions(plan: Column) -> Column:
    def text(a: Column) -> Column:
        return F.when(a["type"] == "addComment", a["type"]).otherwise(
            F.concat(a["type"], F.lit(":"), F.coalesce(a["arg"], F.lit("unassign")))
        )

    return F.array_join(F.transform(plan, text), ",")


def worth_caching(result: Column, confidence: Column, has_context: Column, hits: Column, question: Column,
                  vector: Column) -> Column:
    """Only confident answers with evidence and an embedding become future evidence."""
    return (
        (result == "answered")
        & (F.coalesce(confidence, F.lit(0.0)) >= CACHE_WRITE_CONFIDENCE)
        & (has_context | (hits > 0))
        & (F.length(question) > 0)
        & vector.isNotNull()
    )


def strong_hit(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """The first strong cache hit per ticket."""
    return hits.where("strong").groupBy(by).agg(F.min_by("ticket_key", "rank").alias("hit_key"))


CLAIM_OF_EVENT = {"claim": "in-progress", "finish": "done", "fail": "failed", "clarify": "none"}


def claim_status(events: DataFrame, key: str = "ticket_key", kind: str = "event", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Current claim of each ticket: the latest claim event decides.

    A clarification clears the claim so that the ticket can be taken up again.
    """
    state = F.lit(None).cast("string")
    for event, status in CLAIM_OF_EVENT.items():
        state = F.when(F.col(kind) == event, F.lit(status)).otherwise(state)
    known = events.withColumn("__state", state).where(F.col("__state").isNotNull())
    return known.groupBy(key).agg(
        F.max_by("__state", F.struct(at, tie)).alias("status"),
        F.count_if(F.col(kind) == "claim").alias("n_claims"),
        F.count(F.lit(1)).alias("n_events"),
    )


# -- model input --------------------------------------------------------------

# The texts around a model's input, by part.
TICKET_LINES = ("key", "type", "status", "reporter", "summary")
EMPTY = {"description": "(empty)", "reporter": "unknown", "comments": "(none)", "similar_resolved_tickets": "(none)", "retrieved_context": "(none retrieved)"}
SPEAKERS = {"agent": "agent (you)", "other": "reporter/user"}
BETWEEN = "\n---\n"
COMMENT = "[{speaker} — {name}]\n{body}"
CACHE_HIT = "[{key} — similarity {score}{strong}]\nQuestion: {question}\nResolution: {resolution}"
STRONG = ", strong match"


def _filled(template: str, **values: Column) -> Column:
    """The template with its ``{names}`` replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])


def _block(name: str, body: Column) -> Column:
    shown = F.when(F.length(body) > 0, body).otherwise(F.lit(EMPTY[name]))
    return F.concat(F.lit(f"<{name}>\n"), shown, F.lit(f"\n</{name}>"))


def _joined(lines: Column) -> Column:
    return F.array_join(F.coalesce(lines, F.array().cast("array<string>")), BETWEEN)


def ticket_block(key: Column, kind: Column, status: Column, reporter: Column, summary: Column, description: Column) -> Column:
    known = F.coalesce(reporter, F.lit(EMPTY["reporter"]))
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in zip(TICKET_LINES, (key, kind, status, known, summary), strict=True)]
    text = F.when(F.length(description) > 0, description).otherwise(F.lit(EMPTY["description"]))
    return F.concat_ws("\n", F.lit("<ticket>"), *lines, F.lit("description:"), text, F.lit("</ticket>"))


def comment_line(author: Column, name: Column, body: Column, agent: str) -> Column:
    speaker = F.when(author == agent, SPEAKERS["agent"]).otherwise(SPEAKERS["other"])
    return _filled(COMMENT, speaker=speaker, name=name, body=body)


def comments_block(lines: Column) -> Column:
    return _block("comments", _joined(lines))


def cache_hit_line(key: Column, score: Column, strong: Column, question: Column, resolution: Column) -> Column:
    mark = F.when(strong, F.lit(STRONG)).otherwise(F.lit(""))
    return _filled(CACHE_HIT, key=key, score=fixed(score, 2), strong=mark, question=question, resolution=resolution)


def cache_hits_block(lines: Column) -> Column:
    return _block("similar_resolved_tickets", _joined(lines))


def context_block(context: Column) -> Column:
    return _block("retrieved_context", F.coalesce(context, F.lit("")))


def prompt_parts(tickets: DataFrame, comments: DataFrame, context: DataFrame, agent: str, cached: DataFrame | None = None) -> DataFrame:
    """A model's input as ordered rows (ticket_key, section, place, text).

    Section 0 is the ticket, 1 its comments, the last the retrieved context. With
    ``cached`` (ticket_key, rank, hit_key, score, strong, question, resolution)
    section 2 are the similar tickets of the cache. Rows stay
    separate, so a ticket with very many comments is no problem; the text is
    joined where the model is called.
    """
    head = tickets.select(
        "ticket_key", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"),
        ticket_block(*[F.col(c) for c in ("ticket_key", "issue_type", "status", "reporter_name", "summary", "description")]).alias("text"),
    )
    keys = tickets.select("ticket_key")
    said = comments.join(keys, "ticket_key", "left_semi").select(
        "ticket_key", F.lit(1).alias("section"), F.col("place").cast("long").alias("place"),
        comment_line(F.col("author"), F.col("author_name"), F.col("body"), agent).alias("text"),
    )
    silent = keys.join(comments, "ticket_key", "left_anti").select(
        "ticket_key", F.lit(1).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(EMPTY["comments"]).alias("text")
    )
    if cached is not None:
        line = cache_hit_line(F.col("hit_key"), F.col("score"), F.col("strong"), F.col("question"), F.col("resolution"))
        # A ticket has a few hits, so no key is hot; the number of tasks follows the input.
        parts = join_parts(keys, cached)
        own, hits = keys.repartition(parts, "ticket_key"), cached.repartition(parts, "ticket_key")
        similar = hits.join(own, "ticket_key", "left_semi").select("ticket_key", F.lit(2).alias("section"), F.col("rank").cast("long").alias("place"), line.alias("text"))
        none = own.join(hits.select("ticket_key"), "ticket_key", "left_anti").select("ticket_key", F.lit(2).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(EMPTY["comments"]).alias("text"))
        said = said.unionByName(similar).unionByName(none)
    found = keys.join(context.select("ticket_key", "context"), "ticket_key", "left").select(
        "ticket_key", F.lit(2 if cached is None else 3).alias("section"), F.lit(0).cast("long").alias("place"), context_block(F.col("context")).alias("text")
    )
    return head.unionByName(said).unionByName(silent).unionByName(found)
