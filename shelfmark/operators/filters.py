"""Row predicates: labels, attachments, tickets, roles and profile checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import valid_identifier

# Pages with these labels are left out unless told otherwise.
EXCLUDED_LABELS = ("ignore", "draft", "archived")
# Image kinds that can be captioned.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")
MAX_ATTACHMENT_BYTES = 5_000_000
# Names that stand for "nothing chosen".
DEFAULT_PROFILE = "default"
DEFAULT_ROLE = "default"
DEFAULT_CHUNKER = "html_section"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def clean_labels(labels: Column) -> Column:
    return F.array_compact(F.coalesce(labels, F.array().cast("array<string>")))


def keep_by_labels(labels: Column, include: Sequence[str] | None = None,
                   exclude: Sequence[str] | None = EXCLUDED_LABELS) -> Column:
    """An excluded label drops the page; an include list, if any, must be met."""
    have = clean_labels(labels)
    wanted = F.arrays_overlap(have, _strings(include)) if include else F.lit(True)
    return wanted & (~F.arrays_overlap(have, _strings(exclude)) if exclude else F.lit(True))


def modified_since(last_modified: Column, since: str) -> Column:
    """Whole days: everything from the start of the day of ``since`` on."""
    return F.try_to_timestamp(last_modified) >= F.date_trunc("day", F.lit(since).cast("timestamp"))


def eligible_attachment(media_type: Column, stated_size: Column, real_size: Column,
                        most: int = MAX_ATTACHMENT_BYTES) -> Column:
    return media_type.isin(*IMAGE_TYPES) & (F.coalesce(stated_size, F.lit(0)) <= most) & (real_size <= most)


# -- tickets ----------------------------------------------------------------

# Event names and the minutes after which a claim is stale.
LABEL_IN_PROGRESS = "agent-in-progress"
LABEL_DONE = "agent-done"
LABEL_FAILED = "agent-failed"
AGENT_LABELS = (LABEL_IN_PROGRESS, LABEL_DONE, LABEL_FAILED)
ISSUE_EVENTS = ("jira:issue_created", "jira:issue_updated")
STALE_MINUTES = 30


def untouched(labels: Column) -> Column:
    return ~F.arrays_overlap(clean_labels(labels), _strings(AGENT_LABELS))


def tickets_to_process(tickets: DataFrame, project: str, agent: str, page: int | None = None) -> DataFrame:
    """Open tickets of the agent that no agent label has touched, oldest first.

    ``page`` bounds one poll; without it all of them are returned.
    """
    found = tickets.where(
        (F.col("project_key") == project)
        & (F.col("assignee") == agent)
        & (F.col("status_category") != "done")
        & untouched(F.col("labels"))
    )
    return found.orderBy("created", "ticket_key").limit(page) if page else found


def stale_claims(tickets: DataFrame, project: str, now: str, minutes: int = STALE_MINUTES) -> DataFrame:
    """Tickets claimed but not updated for a while."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return tickets.where(
        (F.col("project_key") == project)
        & F.array_contains(clean_labels(F.col("labels")), LABEL_IN_PROGRESS)
        & (F.col("updated").cast("timestamp") <= limit)
    )


def may_claim(labels: Column, assignee: Column, agent: str) -> Column:
    return untouched(labels) & F.coalesce(assignee == agent, F.lit(False))


def issue_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Ticket events worth handling; anything malformed is ignored."""
    shape = "webhookEvent string, issue struct<key: string>"
    parsed = F.from_json(F.col(payload), shape, {"mode": "PERMISSIVE"})
    return (
        events.withColumn("__event", parsed)
        .select(*events.columns, F.col("__event.webhookEvent").alias("event"), F.col("__event.issue.key").alias("ticket_key"))
        .where(F.col("event").isin(*ISSUE_EVENTS) & (F.length("ticket_key") > 0))
    )


# -- roles and tools ---------------------------------------------------------


def role_from_claims(claims: Column) -> Column:
    """First realm role, else the plain role claim; null without either."""
    parsed = F.try_parse_json(claims)
    first = F.try_variant_get(parsed, "$.realm_access.roles[0]", "string")
    plain = F.try_variant_get(parsed, "$.role", "variant")
    is_text = F.schema_of_variant(plain) == "STRING"
    return F.coalesce(first, F.when(is_text, F.try_variant_get(parsed, "$.role", "string")))


def resolve_role(claims: Column, headers: Sequence[Column], *, verified: bool) -> Column:
    """With verified claims headers are ignored; else the first filled header counts."""
    if verified:
        return F.coalesce(role_from_claims(claims), F.lit(DEFAULT_ROLE))
    filled = [F.when(F.length(F.trim(h)) > 0, F.trim(h)) for h in headers]
    return F.coalesce(*filled, F.lit(DEFAULT_ROLE))


def check_tool_config(config: Mapping[str, Sequence[str]]) -> None:
    for role, tools in config.items():
        if isinstance(tools, str) or not all(isinstance(tool, str) for tool in tools):
            raise ValueError(f"tools of role {role!r} must be a list of names")


def allowed_tools(requests: DataFrame, grants: DataFrame, tools: Sequence[str], *, restricted: bool = True) -> DataFrame:
    """Adds allowed_tools: those of the role, else of the default role, else none.

    ``grants`` has one row per role with its tools array. ``restricted=False``
    is an empty configuration and allows everything.
    """
    every = _strings(tools)
    if not restricted:
        return requests.withColumn("allowed_tools", every)
    own = grants.select("role", F.col("tools").alias("__own"))
    spare = grants.where(F.col("role") == DEFAULT_ROLE).select("tools").take(1)  # one role's list, so a literal
    fallback = _strings(spare[0].tools or ()) if spare else F.array().cast("array<string>")
    joined = requests.join(own, "role", "left")
    return joined.withColumn("allowed_tools", F.array_intersect(every, F.coalesce("__own", fallback))).drop("__own")


# -- profiles ----------------------------------------------------------------


def check_profiles(profiles: DataFrame) -> DataFrame:
    """Adds ``problem`` to each profile row: reserved, duplicate or invalid name."""
    counts = profiles.groupBy("name").agg(F.count(F.lit(1)).alias("__n"))
    joined = profiles.join(counts, profiles["name"].eqNullSafe(counts["name"]), "left").drop(counts["name"])
    problem = (
        F.when(F.col("name") == DEFAULT_PROFILE, "reserved name")
        .when(~valid_identifier(F.col("name")), "invalid identifier")
        .when(F.col("__n") > 1, "duplicate name")
    )
    return joined.withColumn("problem", problem).drop("__n")


def complete_profiles(profiles: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """Fill missing settings with the base configuration; one table per profile."""
    return profiles.select(
        "name",
        F.coalesce("chunker", F.lit(DEFAULT_CHUNKER)).alias("chunker"),
        F.coalesce("embedding_provider", F.lit(provider)).alias("embedding_provider"),
        F.coalesce("embedding_model", F.lit(model)).alias("embedding_model"),
        F.coalesce("embedding_dimensions", F.lit(dimensions)).alias("embedding_dimensions"),
        F.concat(F.lit("chunks_"), F.col("name")).alias("table_name"),
    )


def resolve_profiles(names: DataFrame, registry: DataFrame, fallback: Mapping[str, object] | None) -> DataFrame:
    """Registry settings by profile name, else the fallback, else an error text."""
    fields = ["table_name", "embedding_provider", "embedding_model", "embedding_dimensions"]
    rows = registry.select(F.col("profile_name").alias("name"), F.lit(True).alias("__found"), *fields)
    joined = names.join(rows, "name", "left")
    usable = fallback is not None and all(fallback.get(f) for f in ("embedding_provider", "embedding_model"))

    def value(field: str) -> Column:
        spare = F.lit(fallback.get(field)) if usable else F.lit(None)
        return F.when(F.col("__found"), F.col(field)).otherwise(spare).alias(field)

    missing = F.col("__found").isNull()
    return joined.select(
        *names.columns,
        *[value(f) for f in fields],
        F.when(missing & F.lit(not usable), "profile not found and no fallback configured").alias("error"),
    )
