"""Tickets and comments from landed JSON, with missing fields filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import strip
from shelfmark.operators.records import rich_text

_USER = "struct<accountId: string, displayName: string>"
# Descriptions and comment bodies are trees or plain strings; they stay JSON text.
TICKET = (
    "key string, fields struct<summary: string, description: variant, "
    f"reporter: {_USER}, assignee: {_USER}, "
    "status: struct<name: string, statusCategory: struct<key: string>>, "
    "issuetype: struct<name: string>, labels: array<string>, created: string, updated: string>"
)
COMMENTS = (
    f"key string, comments array<struct<id: string, author: {_USER}, body: variant, created: string>>"
)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICKET).json(path)


def parse_tickets(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, TICKET).alias("t")).select("t.*")


def _plain(body: Column) -> Column:
    """Plain strings are handled in the JVM; only document trees go to Python."""
    is_text = F.schema_of_variant(body) == "STRING"
    tree = rich_text(F.when(~is_text, F.to_json(body)))
    return F.when(is_text, strip(F.try_variant_get(body, "$", "string"))).otherwise(tree)


def normalize_tickets(tickets: DataFrame) -> DataFrame:
    """Flat tickets; users without an account id count as missing."""
    fields = F.col("fields")

    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    def user(name: str) -> tuple[Column, Column]:
        account = F.nullif(fields[name]["accountId"], F.lit(""))
        return account, F.when(account.isNotNull(), text(fields[name]["displayName"]))

    reporter, reporter_name = user("reporter")
    assignee, assignee_name = user("assignee")
    return tickets.select(
        text(F.col("key")).alias("ticket_key"),
        text(fields["summary"]).alias("summary"),
        _plain(fields["description"]).alias("description"),
        reporter.alias("reporter"),
        reporter_name.alias("reporter_name"),
        assignee.alias("assignee"),
        assignee_name.alias("assignee_name"),
        text(fields["status"]["name"]).alias("status"),
        text(fields["status"]["statusCategory"]["key"]).alias("status_category"),
        text(fields["issuetype"]["name"]).alias("issue_type"),
        F.coalesce(fields["labels"], F.array().cast("array<string>")).alias("labels"),
        text(fields["created"]).alias("created"),
        text(fields["updated"]).alias("updated"),
    )


def normalize_comments(df: DataFrame) -> DataFrame:
    """One row per comment with author, plain text body and place in the ticket."""
    rows = df.select(F.col("key").alias("ticket_key"), F.posexplode("comments").alias("place", "c"))
    account = F.nullif(F.col("c.author.accountId"), F.lit(""))
    return rows.select(
        "ticket_key",
        "place",
        F.coalesce("c.id", F.lit("")).alias("comment_id"),
        F.coalesce(account, F.lit("")).alias("author"),
        F.when(account.isNotNull(), F.coalesce("c.author.displayName", F.lit(""))).otherwise("").alias("author_name"),
        _plain(F.col("c.body")).alias("body"),
        F.coalesce("c.created", F.lit("")).alias("created"),
    )
